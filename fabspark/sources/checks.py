"""Contract checks: file integrity and nested question banks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .checksums import file_checksums as file_checksums


def verify_checksums(actual: DataFrame, expected: DataFrame) -> DataFrame:
    """(path, status): ok, changed, missing or new."""
    both = actual.select("path", "sha256").join(expected.select("path", F.col("sha256").alias("expected")), "path", "full_outer")
    status = (
        F.when(F.col("sha256").isNull(), "missing")
        .when(F.col("expected").isNull(), "new")
        .when(F.col("sha256") == F.col("expected"), "ok")
        .otherwise("changed")
    )
    return both.select("path", status.alias("status"))


QUESTION_SCHEMA = (
    "module_id string, sub_module string, title string, week string, "
    "questions array<struct<id:string,type:string,question:string,difficulty:string,points:string,"
    "options:array<string>,correct_answer:string,starter_code:string,test_cases:string,rubric:string>>"
)
# Allowed question types and difficulties.
QUESTION_TYPES = ["multiple_choice", "coding_exercise", "conceptual"]
DIFFICULTIES = ["easy", "medium", "hard"]
QUESTION_FIELDS = ["id", "type", "question", "difficulty", "points"]


def read_question_files(spark: SparkSession, path: str) -> DataFrame:
    """One row per JSON file; broken files keep their text in _corrupt_record."""
    df = spark.read.schema(QUESTION_SCHEMA + ", _corrupt_record string").option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    return df.withColumn("file", F.input_file_name())


def validate_questions(files: DataFrame, types: list[str] = QUESTION_TYPES, difficulties: list[str] = DIFFICULTIES) -> DataFrame:
    """Per file: errors, warnings, number of questions, counts by type.
    A question bank is one bounded document, so its lists stay in its row."""
    required = [F.when(F.col(c).isNull(), F.lit(f"missing field: {c}")) for c in ("module_id", "sub_module", "title", "week", "questions")]
    q = F.coalesce(F.col("questions"), F.array().cast(files.schema["questions"].dataType))

    def label(x):
        return F.coalesce(x["id"], F.lit("?"))

    def problems(x):
        """Missing fields end the checks of a question, as its other rules
        would only repeat them."""
        fields = [F.when(x[f].isNull(), F.concat(label(x), F.lit(f": missing field {f}"))) for f in QUESTION_FIELDS]
        whole = F.lit(True)
        for f in QUESTION_FIELDS:
            whole = whole & x[f].isNotNull()
        index = x["correct_answer"].try_cast("int")
        rules = [
            F.when(~x["type"].isin(types), F.concat(label(x), F.lit(": invalid type"))),
            F.when(~x["difficulty"].isin(difficulties), F.concat(label(x), F.lit(": invalid difficulty"))),
            F.when((x["type"] == "multiple_choice") & x["options"].isNull(), F.concat(label(x), F.lit(": missing options"))),
            F.when((x["type"] == "multiple_choice") & x["correct_answer"].isNull(), F.concat(label(x), F.lit(": missing correct_answer"))),
            F.when(
                (x["type"] == "multiple_choice") & x["options"].isNotNull() & x["correct_answer"].isNotNull()
                & ~F.coalesce(index < F.size(x["options"]), F.lit(False)),
                F.concat(label(x), F.lit(": correct_answer out of range")),
            ),
            F.when((x["type"] == "coding_exercise") & x["test_cases"].isNull(), F.concat(label(x), F.lit(": missing test_cases"))),
        ]
        return F.array_compact(F.array(*fields, *[F.when(whole, r) for r in rules]))

    def remarks(x):
        return F.array_compact(
            F.array(
                F.when((x["type"] == "coding_exercise") & x["starter_code"].isNull(), F.concat(label(x), F.lit(": missing starter_code"))),
                F.when((x["type"] == "conceptual") & x["rubric"].isNull(), F.concat(label(x), F.lit(": missing rubric"))),
            )
        )

    per = F.flatten(F.transform(q, problems))
    ids = F.filter(F.transform(q, lambda x: x["id"]), lambda i: i.isNotNull())
    # Sorted ids put equal ones side by side.
    ordered = F.array_sort(ids)
    again = F.filter(F.transform(ordered, lambda i, n: F.when((n > 0) & (F.get(ordered, n - 1) == i), i)), lambda i: i.isNotNull())
    duplicates = F.transform(again, lambda i: F.concat(F.lit("duplicate id: "), i))
    empty = F.array_compact(F.array(F.when(F.size(q) == 0, F.lit("no questions"))))
    warnings = F.concat(empty, F.flatten(F.transform(q, remarks)))
    broken = F.array_compact(F.array(F.when(F.col("_corrupt_record").isNotNull(), F.lit("invalid JSON"))))
    out = files.select(
        "file",
        F.concat(broken, F.array_compact(F.array(*required)), per, duplicates).alias("errors"),
        warnings.alias("warnings"),
        F.size(q).alias("n_questions"),
        F.map_from_arrays(
            F.array(*[F.lit(t) for t in types]), F.array(*[F.size(F.filter(q, _of_type(t))) for t in types])
        ).alias("by_type"),
    )
    return out.withColumn("valid", F.size("errors") == 0)


def _of_type(t: str):
    def check(x):
        return x["type"] == t

    return check
