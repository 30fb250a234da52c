"""Labels and links of genes and positions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def position(seqname: str = "seqname", start: str = "start", end: str = "end") -> Column:
    return F.concat_ws("", F.col(seqname), F.lit(":"), F.col(start).cast("string"), F.lit("-"), F.col(end).cast("string"))


def link(url: Column, label: Column) -> Column:
    """An HTML anchor that opens in a new tab."""
    return F.concat(F.lit('<a href="'), url, F.lit('" target="_blank">'), label, F.lit("</a>"))


def gene_url(base: str, gene: str = "gene") -> Column:
    """A base address with the encoded symbol behind it; NULL without a gene."""
    return F.concat(F.lit(base), F.url_encode(gene))


#: Addresses of public gene and variant browsers.
SEARCH = "https://www.google.com/search?q="
SYMBOL_PAGES = {"hgnc": "http://www.genenames.org/cgi-bin/gene_symbol_report?match=", "gene_cards": "http://www.genecards.org/cgi-bin/carddisp.pl?gene="}
REGION_PAGES = {"exac": "http://exac.broadinstitute.org/region/", "gnomad": "http://gnomad.broadinstitute.org/region/"}
GENOME_BROWSER = "http://grch37.ensembl.org/Homo_sapiens/Location/View?r="
#: Names of the metrics on axes, and of strand protocols.
METRIC_LABELS = {"jaccard": "Intron-Jaccard-Index", "psi5": "psi[5]", "psi3": "psi[3]", "theta": "theta"}
STRAND_LABELS = {0: "no", 1: "yes (forward)", 2: "yes (reverse)"}


def link_table(df: DataFrame, anchors: bool = True, symbol: str = "symbol", extend: int = 1000) -> DataFrame:
    """Symbol and range of each row with links to searches, gene pages and browsers of its region, as anchors or as plain addresses."""
    short = F.regexp_replace("seqname", "^chr", "")
    region = F.concat(short, F.lit("-"), F.col("start").cast("string"), F.lit("-"), F.col("end").cast("string"))
    place = F.concat(short, F.lit(":"), F.col("start").cast("string"), F.lit("-"), F.col("end").cast("string"))
    wide = F.concat(F.lit(GENOME_BROWSER), short, F.lit("%3A"), F.greatest(F.lit(0), F.col("start") - extend).cast("string"), F.lit("-"), (F.col("end") + extend).cast("string"))
    show = lambda url, label: link(url, label) if anchors else url
    name = F.col(symbol)
    columns = {"search": show(F.concat(F.lit(SEARCH), name), name)}
    columns |= {n: show(F.concat(F.lit(base), name), name) for n, base in SYMBOL_PAGES.items()}
    columns |= {n: show(F.concat(F.lit(SEARCH), F.lit(f"{word} "), name), name) for n, word in (("ensembl", "ENSEMBL"), ("omim", "OMIM"))}
    columns |= {n: show(F.concat(F.lit(base), region), place) for n, base in REGION_PAGES.items()}
    columns["ensembl_browser"] = show(wide, place)
    return df.select(name.alias("symbol"), "seqname", "start", "end", *[c.alias(n) for n, c in columns.items()])


def metric_label(metric: str = "type") -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in METRIC_LABELS.items() for x in kv]), F.col(metric))


def strand_label(samples: DataFrame) -> DataFrame:
    """One row: the strand protocol of all samples in words; both directions together have a word of their own."""
    names = F.element_at(F.create_map(*[F.lit(x) for kv in STRAND_LABELS.items() for x in kv]), F.col("strand_mode"))
    found = samples.agg(F.sort_array(F.collect_set(names)).alias("n"))
    return found.select(F.when(F.size("n") == 2, "yes (forward and reverse)").otherwise(F.element_at("n", 1)).alias("strand"))


def capped_logit(ratio: str, by: str | None = None, digits: int = 2) -> Column:
    """logit of a ratio rounded to some digits and kept within one step of 0 and 1; with ``by`` a missing ratio gets the largest value of its row."""
    low = 10.0**-digits
    v = F.greatest(F.lit(low), F.least(F.lit(1 - low), F.bround(ratio, digits)))
    out = F.when(F.col(ratio).isNotNull(), F.ln(v / (1 - v)))
    return out if by is None else F.coalesce(out, F.max(out).over(Window.partitionBy(by)))


def autoencoder_input(k: str, n: str, by: str = "junction_id", pseudocount: float = 0.1, noise: Column | None = None, noise_share: float = 0.0) -> Column:
    """Logit ratios of a row less their mean; ``noise`` (standard normal draws) is added by a share of the row's standard deviation."""
    row = Window.partitionBy(by)
    x = F.ln((F.col(k) + pseudocount) / (F.col(n) - F.col(k) + pseudocount))
    x = F.coalesce(x, F.max(x).over(row) + 1)
    if noise is not None:
        x = x + noise * noise_share * F.stddev_samp(x).over(row)
    return x - F.avg(x).over(row)


def log2_fold_change(real: str, predicted: str) -> Column:
    return F.log2(real) - F.log2(predicted)
