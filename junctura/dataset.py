"""The data model: samples, junctions, splice sites and their counts as DataFrames."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, functions as F

METRICS = ("jaccard", "psi5", "psi3", "theta")
#: Strand protocols by number and name.
STRAND_MODES = {"no": 0, "yes": 1, "forward": 1, "reverse": 2}


def resolved_metric(name: str) -> str:
    """The metric that a name stands for, whatever its case and whatever stands around it."""
    low = name.lower()
    found = [m for m in METRICS if m in low]
    if len(found) != 1:
        raise ValueError(f"{name!r} names none or several of {METRICS}")
    return found[0]


def feature_of(metric: str) -> str:
    """site_id for theta, junction_id for the others."""
    return "site_id" if resolved_metric(metric) == "theta" else "junction_id"


def strand_mode(value: int | str | bool) -> int:
    """0 (unstranded), 1 or 2 (reverse) of a number, a name or whether there is strand information."""
    if isinstance(value, str):
        if value.lower() not in STRAND_MODES:
            raise ValueError(f"strand mode must be one of {sorted(STRAND_MODES)}")
        return STRAND_MODES[value.lower()]
    if int(value) not in (0, 1, 2):
        raise ValueError("strand mode must be 0, 1 or 2")
    return int(value)


def checked_number(value: float | None, low: float = float("-inf"), high: float = float("inf"), null: bool = True, name: str = "value") -> float | None:
    """``value`` if it is a number within bounds, or None where that is allowed; else an error."""
    if value is None or isinstance(value, float) and value != value:
        if null:
            return None
        raise ValueError(f"{name} must not be missing")
    if isinstance(value, bool) or not isinstance(value, (int, float)):
        raise TypeError(f"{name} must be a number")
    if not low <= value <= high:
        raise ValueError(f"{name} must be within {low} and {high}")
    return value


@dataclass(frozen=True)
class SpliceDataset:
    """Counts in long form. junctions: junction_id, seqname, start, end, strand, start_id, end_id; sites:
    site_id, seqname, start, end, strand, type; j_counts and ss_counts: an id, sample_id and k."""

    samples: DataFrame
    junctions: DataFrame
    sites: DataFrame
    j_counts: DataFrame
    ss_counts: DataFrame
    name: str = "dataset"
    params: dict = field(default_factory=dict)

    def with_(self, **changes) -> "SpliceDataset":
        return replace(self, **changes)

    def grid(self) -> DataFrame:
        """Every junction in every sample; what was not counted is 0. Samples are few, so they are broadcast within Spark's own threshold."""
        cells = self.junctions.crossJoin(self.samples.select("sample_id"))
        return cells.join(self.j_counts, ["junction_id", "sample_id"], "left").withColumn("k", F.coalesce("k", F.lit(0)).cast("long"))

    def site_grid(self) -> DataFrame:
        cells = self.sites.crossJoin(self.samples.select("sample_id"))
        return cells.join(self.ss_counts, ["site_id", "sample_id"], "left").withColumn("k", F.coalesce("k", F.lit(0)).cast("long"))

    def problems(self) -> list[str]:
        """Broken rules of the model, empty for a valid dataset."""
        out = []
        if not self.samples.groupBy("sample_id").count().filter("count > 1 or sample_id is null").isEmpty():
            out.append("sample_id must be unique and not null")
        if "strand_mode" in self.samples.columns:
            if not self.samples.filter("strand_mode not in (0, 1, 2)").isEmpty():
                out.append("strand_mode must be 0, 1 or 2")
            if self.samples.agg(F.count_distinct(F.col("strand_mode") > 0)).first()[0] > 1:
                out.append("unstranded and stranded samples cannot be mixed")
        ends = self.junctions.select(F.explode(F.array("start_id", "end_id")).alias("site_id"))
        if not self.sites.join(ends, "site_id", "left_anti").isEmpty():
            out.append("every site must belong to a junction")
        if not self.junctions.filter("end < start").isEmpty():
            out.append("a junction must not end before it starts")
        if not re.fullmatch(r"[A-Za-z0-9._-]+", self.name):
            out.append("the name must consist of letters, digits, dots, dashes and underscores")
        if "paired_end" in self.samples.columns and dict(self.samples.dtypes)["paired_end"] != "boolean":
            out.append("paired_end must be true or false")
        if "bam" in self.samples.columns and dict(self.samples.dtypes)["bam"] != "string":
            out.append("bam must be a path")
        if not self.sites.filter("type is null or type not in ('Donor', 'Acceptor')").isEmpty():
            out.append("a site must be a donor or an acceptor")
        for table, key in ((self.junctions, "junction_id"), (self.sites, "site_id")):
            on = [key] if key == "junction_id" else [key, "seqname", "start", "end", "strand"]
            if not table.groupBy(*on).count().filter(F.col("count") > 1).isEmpty():
                out.append(f"{key} must be unique")
        for table, key, known in ((self.j_counts, "junction_id", self.junctions), (self.ss_counts, "site_id", self.sites)):
            if not table.join(known.select(key), key, "left_anti").isEmpty() or not table.join(self.samples.select("sample_id"), "sample_id", "left_anti").isEmpty():
                out.append(f"counts by {key} must belong to a feature and a sample")
            if not table.filter("k is null or k < 0").isEmpty():
                out.append(f"counts by {key} must not be missing or negative")
        return out

    def checked(self) -> "SpliceDataset":
        """The dataset itself if it breaks no rule; else an error that names the rules."""
        if found := self.problems():
            raise ValueError("; ".join(found))
        return self

    def features(self, metric: str = "jaccard") -> DataFrame:
        """Sites for theta, junctions for the other metrics."""
        return self.sites if resolved_metric(metric) == "theta" else self.junctions

    def counts(self, metric: str = "jaccard", side: str = "interest") -> DataFrame:
        """The feature, sample_id and k: reads of interest (K), other reads (o) or both (n)."""
        from .operators import metrics

        if side not in ("interest", "other", "total"):
            raise ValueError("side must be interest, other or total")
        m, key = resolved_metric(metric), feature_of(metric)
        cells = metrics.site_theta(self) if m == "theta" else metrics.intron_jaccard(self) if m == "jaccard" else metrics.prime_sites(self)
        o = F.col(f"o_{m}")
        value = {"interest": F.col("k"), "other": o, "total": F.col("k") + o}[side]
        also = [] if m != "theta" else ["seqname", "start", "end", "strand"]
        return cells.select(key, *also, "sample_id", value.cast("long").alias("k"))

    def with_strand_mode(self, value) -> "SpliceDataset":
        return self.with_(samples=self.samples.withColumn("strand_mode", F.lit(strand_mode(value))))

    def with_feature_column(self, name: str, values: DataFrame, metric: str = "jaccard") -> "SpliceDataset":
        """A further column of the features, by their id; features that ``values`` does not have get NULL."""
        key = feature_of(metric)
        kept = self.features(metric).drop(name)
        table = "sites" if key == "site_id" else "junctions"
        return self.with_(**{table: kept.join(values.select(key, name), key, "left")})

    def subset(self, junctions: DataFrame | None = None, samples: DataFrame | None = None, sites: DataFrame | None = None) -> "SpliceDataset":
        """The rows whose ids are in the given tables; sites follow junctions, or junctions the sites they touch."""
        out = self
        if sites is not None:
            ids = sites.select("site_id").distinct()
            touched = self.junctions.select("junction_id", F.explode(F.array("start_id", "end_id")).alias("site_id")).join(ids, "site_id", "left_semi").select("junction_id").distinct()
            out = out.with_(junctions=out.junctions.join(touched, "junction_id", "left_semi"), sites=out.sites.join(ids, "site_id", "left_semi"))
        if junctions is not None:
            kept = out.junctions.join(junctions.select("junction_id").distinct(), "junction_id", "left_semi")
            ends = kept.select(F.explode(F.array("start_id", "end_id")).alias("site_id")).distinct()
            out = out.with_(junctions=kept, sites=out.sites.join(ends, "site_id", "left_semi"))
        if samples is not None:
            ids = samples.select("sample_id").distinct()
            out = out.with_(samples=out.samples.join(ids, "sample_id", "left_semi"), j_counts=out.j_counts.join(ids, "sample_id", "left_semi"), ss_counts=out.ss_counts.join(ids, "sample_id", "left_semi"))
        return out.with_(j_counts=out.j_counts.join(out.junctions.select("junction_id"), "junction_id", "left_semi"), ss_counts=out.ss_counts.join(out.sites.select("site_id"), "site_id", "left_semi"))
