"""Validation of JSONL records: issue tags, histogram, first bad lines and token statistics."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.counters import APPROX, Counter, get_counter
from ..sources import readers
from ..tables import cut, discard
from . import formats as R
from . import messages as M


@dataclass
class ValidationReport:
    total: int = 0
    valid: int = 0
    issues: dict[str, int] = field(default_factory=dict)
    invalid: list[tuple[int, tuple[str, ...]]] = field(default_factory=list)
    tokens: dict[str, float] | None = None

    @property
    def ok(self) -> bool:
        return self.total > 0 and self.valid == self.total

    def summary(self) -> str:
        lines = [f"records: {self.total}", f"valid: {self.valid}", f"invalid: {self.total - self.valid}"]
        lines += [f"  {tag}: {n}" for tag, n in self.issues.items()]
        lines += [f"  line {n}: {', '.join(tags)}" for n, tags in self.invalid]
        if self.tokens:
            lines.append("tokens: " + ", ".join(f"{k} {v}" for k, v in self.tokens.items()))
        return "\n".join(lines)


def issue_histogram(records: DataFrame) -> DataFrame:
    """(issue, n): occurrences of each tag, commonest first, then by name."""
    return records.select(F.explode("issues").alias("issue")).groupBy("issue").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "issue")


def token_stats(records: DataFrame, budget: int = 16385, counter: Counter = APPROX) -> DataFrame:
    fine = records.where(F.size("issues") == 0).select(M.example_tokens(R.decode(F.col("rec"), F.col("fmt")), counter).alias("t"))
    return fine.agg(F.count("t").alias("n"), F.min("t").alias("min"), F.max("t").alias("max"), F.avg("t").alias("mean"), F.count_if(F.col("t") > budget).alias("over_budget"))


def validate_records(lines: DataFrame, fmt: str = "auto", budget: int = 16385, max_listed: int = 20, counter: str | Counter | None = None) -> ValidationReport:
    """Report on (line_no, raw) rows; what reaches the driver has a fixed size."""
    records = cut(readers.pinned(lines, fmt).select("line_no", "fmt", "issues", "rec"), "validated")
    counts = records.agg(F.count(F.lit(1)), F.count_if(F.size("issues") == 0)).first()
    report = ValidationReport(int(counts[0]), int(counts[1]))
    report.issues = {r.issue: r.n for r in issue_histogram(records).collect()}
    bad = records.where(F.size("issues") > 0).orderBy("line_no").select("line_no", "issues").limit(max_listed)
    report.invalid = [(r.line_no, tuple(r.issues)) for r in bad.collect()]
    if report.valid:
        report.tokens = token_stats(records, budget, get_counter(counter)).first().asDict()
    discard(records)
    return report


def validate_jsonl(spark: SparkSession, path: str, fmt: str = "auto", budget: int = 16385, max_listed: int = 20, counter: str | Counter | None = None) -> ValidationReport:
    return validate_records(readers.read_jsonl(spark, path), fmt, budget, max_listed, counter)
