"""The whole analysis of a dataset: for each metric a fit, p-values, adjusted p-values, and tables of results."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F

from .dataset import SpliceDataset, resolved_metric
from .functions import betabinomial as bb
from .operators import encoder, filters, fitting, metrics, padjust, results
from .operators.ranks import precision_recall_auc
from .sources import shared

IMPLEMENTATIONS = ("PCA", "PCA-regression", "PCA-reg-full", "PCA-BB-Decoder", "PCA-BB-Decoder-weighted", "PCA-BB-Decoder-no-weights", "PCA-BB-full", "AE", "AE-weighted", "fullAE", "BB")
#: Those whose encoder sees all junctions; the others see a subset of variable ones.
FULL = ("PCA", "PCA-reg-full", "PCA-BB-full", "fullAE", "BB")
DISTRIBUTIONS = ("beta_binomial", "binomial", "normal")


@dataclass(frozen=True)
class Analysis:
    """Tested cells by metric (junction_id stands for a site of theta), gene tables, and FDR on subsets of them."""

    dataset: SpliceDataset
    cells: dict[str, DataFrame] = field(default_factory=dict)
    genes: DataFrame | None = None
    gene_p: dict[str, DataFrame] = field(default_factory=dict)
    subsets: dict[str, dict[str, DataFrame]] = field(default_factory=dict)
    subset_gene_p: dict[str, dict[str, DataFrame]] = field(default_factory=dict)
    dimensions: dict[str, int] = field(default_factory=dict)


def metric_cells(ds: SpliceDataset, metric: str) -> DataFrame:
    """junction_id, range, index, sample_id, k, n and psi of every cell of a metric; nonsplit for the jaccard index.

    The id of a site may stand on several sequences, so a site of theta is named by its range.
    """
    m = resolved_metric(metric)
    if m == "theta":
        cells = metrics.site_theta(ds).withColumn("junction_id", F.concat_ws(":", "seqname", F.concat_ws("-", F.col("start").cast("string"), F.col("end").cast("string")), "strand"))
        return cells.select("junction_id", "seqname", "start", "end", "strand", F.col("junction_id").alias("index"), "sample_id", "k", (F.col("k") + F.col("o_theta")).alias("n"), F.col("theta").alias("psi"))
    index = metrics.site_index(ds, m).select("junction_id", F.col("index"))
    cells = metrics.intron_jaccard(ds) if m == "jaccard" else metrics.prime_sites(ds)
    also = ["nonsplit"] if m == "jaccard" else []
    out = cells.join(index, "junction_id")
    return out.select("junction_id", "seqname", "start", "end", "strand", "index", "sample_id", "k", (F.col("k") + F.col(f"o_{m}")).alias("n"), F.col(m).alias("psi"), *also)


def encoder_subset(cells: DataFrame, n: int = 15_000, min_delta: float = 0.1, seed: int = 42) -> DataFrame:
    """junction_id and included: of the 2 n most variable junctions among those that deviate by ``min_delta`` from their mean in some sample, n at random."""
    variable = filters.variable_junctions(cells, "psi", min_delta).filter("variable")
    own = cells.join(variable.select("junction_id"), "junction_id", "left_semi").withColumnRenamed("n", "n_jaccard")
    return filters.most_variable(own, n, seed).select("junction_id", F.lit(True).alias("included"))


def fit(cells: DataFrame, q: int | None = None, implementation: str = "PCA", iterations: int = 15, included: DataFrame | None = None, noise: float = 0.0, n_subset: int = 15_000, min_delta: float = 0.1, seed: int = 42) -> DataFrame:
    """junction_id, sample_id, mu and rho by one of ``IMPLEMENTATIONS``; all but BB need the number of latent dimensions.

    All but those of ``FULL`` find the latent values in a subset of junctions: those that ``included`` (junction_id, included) says, or ``encoder_subset`` (all junctions where either has fewer than
    twice the latent dimensions). ``noise`` corrupts the inputs of encoders that are fitted.
    """
    if implementation not in IMPLEMENTATIONS:
        raise ValueError(f"implementation must be one of {IMPLEMENTATIONS}")
    if implementation != "BB" and (q is None or q < 1):
        raise ValueError("q must be at least 1")
    samples = [r.sample_id for r in cells.select("sample_id").distinct().sort("sample_id").collect()]  # one row for each sample
    rows = fitting.packed(cells, "k", "n")
    if implementation == "BB":
        one = fitting.fit_beta_binomial(rows).select("junction_id", "mu", "rho")
        return cells.select("junction_id", "sample_id").join(one, "junction_id")
    if implementation == "PCA":
        found = fitting.fit_pca(rows, q)
    else:
        if implementation not in FULL and included is None and "psi" in cells.columns:
            included = encoder_subset(cells, n_subset, min_delta, seed)
        weighted = implementation in ("AE-weighted", "PCA-BB-Decoder", "PCA-BB-Decoder-weighted", "PCA-BB-full")
        found = encoder.fit_encoded(
            rows, q, iterations, None if implementation in FULL else included, "AE" in implementation, not implementation.startswith("PCA-reg"), weighted, noise, seed
        ).fit
    names = F.array(*[F.lit(s) for s in samples])
    return found.select("junction_id", "rho", F.posexplode("mu").alias("_i", "mu")).select("junction_id", F.element_at(names, F.col("_i") + 1).alias("sample_id"), "mu", "rho")


def with_p_values(cells: DataFrame, distribution: str = "beta_binomial", pseudocount: float = 0.1) -> DataFrame:
    """``cells`` (k, n, mu, rho) with the two-sided p of a distribution."""
    if distribution not in DISTRIBUTIONS:
        raise ValueError(f"distribution must be one of {DISTRIBUTIONS}")
    if distribution == "beta_binomial":
        p = bb.bb_p_value("k", "n", "mu", "rho")
    elif distribution == "binomial":
        p = bb.binomial_p_value("k", "n", "mu")
    else:
        return cells.withColumn("_z", metrics.z_score("k", "n", "mu", "junction_id", pseudocount, centred=False)).withColumn("p", bb.normal_p_value("_z")).drop("_z")
    inside = (F.col("mu") > 0) & (F.col("mu") < 1)
    return cells.withColumn("p", F.when(inside, p))


def analyse(
    ds: SpliceDataset,
    q: int | dict[str, int] | None = None,
    of: tuple[str, ...] = ("jaccard",),
    implementation: str = "PCA",
    iterations: int = 15,
    genes: DataFrame | None = None,
    subsets: dict[str, DataFrame] | None = None,
    method: str = "BY",
    rho_cutoff: float | None = None,
    distribution: str = "beta_binomial",
) -> Analysis:
    """Fits each metric, tests every cell and adjusts the p-values within samples, for sites, genes and subsets of genes.

    ``q``: latent dimensions for all metrics or by metric; where it says nothing, the number by optimal hard thresholding. ``genes``: junction_id and gene.
    ``subsets``: by name, tables of sample_id and gene to which the FDR of a sample is restricted; a sample without genes in it is not tested there.
    """
    cells, gene_p, by_subset, subset_gene_p, dimensions = {}, {}, {}, {}, {}
    for name in of:
        m = resolved_metric(name)
        base = shared.written(metric_cells(ds, m), f"cells-{m}")
        own = q.get(m) if isinstance(q, dict) else q
        if implementation != "BB" and own is None:
            own = fitting.best_dimension(fitting.packed(base, "k", "n"))
        dimensions[m] = own
        fitted = shared.written(fit(base, own, implementation, iterations), f"fit-{m}")
        tested = shared.written(with_p_values(base.join(fitted, ["junction_id", "sample_id"]), distribution), f"p-{m}")
        cells[m] = shared.written(padjust.fdr_per_sample(tested, method=method, rho="rho", rho_cutoff=rho_cutoff), f"tested-{m}")
        if genes is None or m == "theta":
            continue
        passing = tested if rho_cutoff is None else tested.withColumn("p", F.when(F.col("rho") <= rho_cutoff, F.col("p")))
        gene_p[m] = padjust.gene_p_values(passing, genes, method=method)
        by_subset[m], subset_gene_p[m] = {}, {}
        for s, wanted in (subsets or {}).items():
            in_set = cells[m].select("junction_id", "index").distinct().join(genes, "junction_id").join(wanted.distinct(), "gene").select(F.lit(s).alias("subset"), "sample_id", "index").distinct()
            fdr = padjust.fdr_on_subset(cells[m], in_set, method=method).select("sample_id", "index", F.col("padj_subset").alias("padj"))
            by_subset[m][s] = cells[m].drop("padj").join(fdr, ["sample_id", "index"], "left")
            subset_gene_p[m][s] = padjust.gene_fdr_on_subset(gene_p[m], wanted, method=method)
    return Analysis(ds, cells, genes, gene_p, by_subset, subset_gene_p, dimensions)


def result_table(done: Analysis, padj_cutoff: float | None = 0.1, delta_cutoff: float | None = 0.1, min_count: int | None = 5, aggregate: bool = False, collapse: bool = False, all_: bool = False, samples: list | None = None, additional: DataFrame | None = None) -> DataFrame:
    """Outliers of all metrics and FDR sets, a row for each cell; with ``aggregate`` for each aberrant gene, with ``collapse`` for one metric of each gene.

    A cutoff of None does not apply; with ``all_`` none does, and with ``aggregate`` each tested gene and sample has a row then. ``additional``: junction_id and further
    columns of junctions (or sites of theta), which their rows get.
    """
    if not done.cells:
        raise ValueError("no metric has been tested")
    parts: dict[str, DataFrame] = {}
    for m, cells in done.cells.items():
        sets = {"transcriptome_wide": cells, **done.subsets.get(m, {})}
        for name, table in sets.items():
            rows = results.result_columns(table, m)
            if samples is not None:
                rows = rows.filter(F.col("sample_id").isin(samples))
            if aggregate:
                if m not in done.gene_p:
                    continue
                gene_p = done.gene_p[m] if name == "transcriptome_wide" else done.subset_gene_p[m][name]
                cutoffs = (None, None, None) if all_ else (padj_cutoff, delta_cutoff, min_count)
                out = results.gene_results(rows, done.genes, gene_p, *cutoffs)
            else:
                out = results.metric_results(rows, padj_cutoff, delta_cutoff, min_count, all_)
            out = out.drop("p", "padj", "n").withColumn("junction_id", F.col("junction_id").cast("string"))
            parts[name] = out if name not in parts else parts[name].unionByName(out)
    keys = ["junction_id", "sample_id", "type", *(["gene"] if aggregate else [])]
    out = results.with_fdr_sets(parts, keys)
    if collapse:
        out = results.collapsed(out)
    if additional is not None:
        own = additional.withColumn("junction_id", F.col("junction_id").cast("string")).dropDuplicates(["junction_id"])
        if clash := sorted((set(own.columns) & set(out.columns)) - {"junction_id"}):
            raise ValueError(f"result tables have columns {clash} of their own")
        out = out.join(own, "junction_id", "left")
    return out.orderBy("p_value", F.desc(F.abs("delta")), *keys).drop("delta")


def injected_search(cells: DataFrame, dimensions: list[int], implementation: str = "PCA", freq: float = 1e-3, delta: float = 0.2, seed: int = 42, noise: tuple[float, ...] = (0.0,)) -> DataFrame:
    """q, noise and the area under the precision-recall curve of finding injected outliers again, for each number of latent dimensions and each noise.

    All models fit the same injected counts. Those of principal components are one pass over the rows for all of them; other implementations alternate by passes of their
    own, so their models, a short list, are fitted one after another. All curves are swept together.
    """
    moved = fitting.inject_outliers(cells, freq, delta, seed, "index", "n")
    moved = shared.written(moved.withColumn("k", F.col("k_injected")).withColumn("n", F.greatest("n", "k")), "injected")
    labels = moved.select("junction_id", "sample_id", "index", (F.col("injected") != 0).alias("hit"))
    if implementation == "PCA":
        samples = [r.sample_id for r in cells.select("sample_id").distinct().sort("sample_id").collect()]  # one row for each sample
        names = F.array(*[F.lit(s) for s in samples])
        found = encoder.pca_models(fitting.packed(moved, "k", "n"), dimensions, noise, seed)
        tested = found.select("q", "noise", "junction_id", F.posexplode("p").alias("_i", "p")).select("q", "noise", "junction_id", F.element_at(names, F.col("_i") + 1).alias("sample_id"), "p")
    else:
        tested = None
        for q in dimensions:
            for v in noise:
                one = with_p_values(moved.join(fit(moved, q, implementation, noise=v, seed=seed), ["junction_id", "sample_id"]))
                one = shared.written(one.select(F.lit(q).alias("q"), F.lit(float(v)).alias("noise"), "junction_id", "sample_id", "p"), "model")
                tested = one if tested is None else tested.unionByName(one)
    by_site = tested.join(labels, ["junction_id", "sample_id"]).groupBy("q", "noise", "index", "sample_id").agg((-F.min("p")).alias("score"), F.bool_or("hit").alias("label"))
    return precision_recall_auc(by_site, by=["q", "noise"])


def best_dimension(tried: DataFrame) -> int:
    """The number of dimensions of the highest score, the smallest on ties."""
    return tried.orderBy(F.desc_nulls_last("auc"), "q", *([F.col("noise")] if "noise" in tried.columns else [])).first().q


def suggested_dimension(n_samples: int) -> int:
    """A default where nothing was searched: a tenth of the samples, from 2 up to 100."""
    return min(100, max(2, round(n_samples / 10)))


def z_scores(cells: DataFrame, pseudocount: float = 0.1) -> DataFrame:
    return cells.withColumn("z", metrics.z_score("k", "n", "mu", "junction_id", pseudocount))


def pseudocount_delta(cells: DataFrame, pseudocount: float = 0.1) -> DataFrame:
    """delta: the ratio with pseudocounts less the prediction."""
    return cells.withColumn("delta", (F.col("k") + pseudocount) / (F.col("n") + 2 * pseudocount) - F.col("mu"))

