"""Repeated rows, long texts, clashing columns, hot values, and brute-force versions of whole queries."""

import hashlib
import html.parser
import random
import re
import time

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from junctura.llm import bpe, decontaminate, html_text, jaccard_join, line_dedup, pii, quality_classifier, quality_rules, registry, suffix_dedup, text as tx, toxicity

KEY = b"a key of the tests"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LABELS = "doc_id long, quality int, toxic int"


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "en", "s", None if t is None else len(t)) for d, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def words():
    rng = random.Random(8)
    return ["".join(rng.choice("abcdefghijklm") for _ in range(rng.randint(2, 8))) for _ in range(500)]


@pytest.fixture(scope="module")
def long_text(words):
    rng = random.Random(9)
    return "\n".join(" ".join(rng.choice(words) for _ in range(40)) for _ in range(4500))


# --- repeated rows, ids and columns ---------------------------------------------------------------


def test_lines_of_repeated_rows_and_any_ids(spark):
    line = "one two three four five six seven eight nine ten"
    rows = [(3, f"{line}\n{line} eleven\nshort"), (3, f"{line}\n{line} eleven\nshort"), (2**50, f"x\n{line}"), (-(2**60), "x"), (None, line), (9, None), (10, "")]
    docs = frame(spark, rows).withColumns({"_id": F.lit(1), "id": F.lit(2), "places": F.lit(3), "n_lines": F.lit("old"), "word": F.lit("w"), "lead": F.lit(5)})
    got = line_dedup.dedup_lines(docs).collect()
    by_id = {r.doc_id: r for r in got}
    assert len(got) == len(rows) and by_id[3].n_removed == 1 and by_id[3].text == f"{line}\nshort" and by_id[3].n_lines == 3
    assert by_id[2**50].text == "" and by_id[2**50].n_removed == 2 and by_id[-(2**60)].text == "x" and by_id[None].text == line and by_id[9].text is None and by_id[10].text == ""
    assert {by_id[3][c] for c in ("_id", "id", "places")} == {1, 2, 3}


def run_sql(sql, **tables):
    con = duckdb.connect()
    for name, df in tables.items():
        con.register(name, df.toPandas())
    return con.sql(sql).fetchall()


def test_line_query_equals_its_sql_on_repeated_rows(spark, tmp_path):
    line = "one two three four five six seven eight nine ten"
    docs = frame(spark, [(3, f"{line}\n{line} eleven\nshort"), (3, f"{line}\n{line} eleven\nshort"), (4, "short\nShort\nnew"), (5, None), (6, "")])
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(tuple(r) for r in registry.QUERIES["op1_line_dedup"](spark, str(tmp_path)).collect())
    assert got == sorted(run_sql(registry.ORACLE_SQL["op1_line_dedup"], documents=docs))


@pytest.mark.parametrize("block", [500_000, 3])
def test_each_benchmark_row_is_searched_for_itself(spark, tmp_path, block):
    item = "the quick brown fox jumps over the lazy dog again and again"
    docs = frame(spark, [(1, f"see {item} here"), (1, f"see {item} here"), (2, "another text of seven words in all"), (3, None), (4, ""), (5, "two words")])
    bench = spark.createDataFrame([(7, item), (7, item), (7, "another text of seven words in all"), (8, "two words"), (9, None), (10, "!"), (None, "see the quick")], "item_id long, text string")
    want = run_sql(registry.ORACLE_SQL["op7_decontaminate"], documents=docs, benchmark=bench)
    clean = lambda rows: sorted(tuple(-1 if v is None or v != v else int(v) for v in r) for r in rows)
    got = [tuple(r) for r in decontaminate.contained_items(docs, bench, block=block).collect()]
    assert clean(got) == clean(want) == sorted([(1, 7, 8, 8)] * 4 + [(2, 7, 3, 3), (5, 8, 1, 1)] + [(1, -1, 1, 1)] * 2)


def test_short_items_take_linear_time():
    data = np.frombuffer(("word " * 100_000).encode(), np.uint8)
    began = time.time()
    rows, hashes = decontaminate._shingles(data, np.array([0, len(data)]), [1, 2, 5], 5)
    assert len(rows) == len(hashes) == 3 * 100_000 - 5 and time.time() - began < 2


def test_extra_columns_of_the_classifier_stay(spark):
    docs = frame(spark, [(1, "some text"), (1, "some text"), (2, None)]).withColumns({"more": F.lit("x"), "score": F.lit("old"), "kept": F.lit("old")})
    got = quality_classifier.score_documents(docs, spark.createDataFrame([], LABELS))
    assert [r.more for r in got.collect()] == ["x"] * 3 and dict(got.dtypes)["score"] == "double" and got.columns.count("kept") == 1


def test_spans_of_repeated_rows(spark):
    passage = "this passage is longer than fifty bytes so that it counts as repeated"
    got = [(r.doc_id, r.n_removed) for r in suffix_dedup.repeated_spans(frame(spark, [(1, passage), (1, passage), (2, f"x {passage}"), (2, f"x {passage}"), (None, None)])).collect()]
    assert sorted(got, key=str) == sorted([(1, 0), (1, 0), (2, len(passage)), (2, len(passage)), (None, 0)], key=str)


def test_texts_of_one_id_and_of_no_id_are_judged_apart(spark, words):
    """Each text against the strings of smaller ids alone; windows of a text of no id count for nobody."""
    rng = random.Random(21)
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    first, own, late, lone = prose(90), prose(110), prose(70), prose(80)
    rows = [(0, first), (1, first), (1, own), (1, f"{prose(5)} {first[40:300]} {prose(30)}"), (2, f"{prose(9)} {own[:200]} {late}"), (2, late), (2, late), (None, lone), (None, first), (3, f"{lone} {late[10:120]}"), (2**60 + 1, f"{first[:90]} {prose(12)}"), (2**60, f"{prose(4)} {first[:90]}"), (-5, prose(40))]
    want = []
    for d, t in rows:
        raw = t.encode()
        seen = {o[i : i + 50] for e, u in rows for o in [u.encode()] for i in range(len(o) - 49) if d is not None and e is not None and e < d}
        gone = bytearray(len(raw))
        for i in range(len(raw) - 49):
            if raw[i : i + 50] in seen:
                gone[i : i + 50] = b"\1" * 50
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        want.append((d, len(raw), sum(gone), sum(1 for i in range(len(raw)) if gone[i] and (i == 0 or not gone[i - 1])), hashlib.sha256(kept).hexdigest()))
    for frequent in (2, 20_000):
        got = suffix_dedup.repeated_spans(frame(spark, rows).repartition(3), frequent=frequent).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
        assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    texts = {(r.doc_id, hashlib.sha256(r.kept).hexdigest()) for r in suffix_dedup.repeated_spans(frame(spark, rows), with_text=True).collect()}
    assert texts == {(w[0], w[4]) for w in want}


def test_longest_previous_factors_against_brute_force():
    rng = random.Random(2)
    docs = ["".join(rng.choice("ab") for _ in range(rng.randint(60, 90))) for _ in range(6)]
    docs += [docs[1], docs[0][:70], "a" * 80]
    text = np.frombuffer("".join(docs).encode(), np.uint8)
    starts = np.cumsum([0, *map(len, docs)])
    at = np.concatenate([np.arange(a, b - suffix_dedup.SPAN + 1) for a, b in zip(starts, starts[1:], strict=False)])
    owner = np.concatenate([np.full(len(d) - suffix_dedup.SPAN + 1, i) for i, d in enumerate(docs)])
    raw = text.tobytes()
    cut = [raw[p : p + suffix_dedup.SPAN] for p in at.tolist()]

    def common(a, b):
        n = 0
        while n < len(a) and a[n] == b[n]:
            n += 1
        return n

    want = [max((common(c, cut[j]) for j in range(len(cut)) if owner[j] < owner[i]), default=0) for i, c in enumerate(cut)]
    assert suffix_dedup.longest_previous_factors(text, at, owner).tolist() == want


def test_components_of_repeated_rows(spark):
    t = "a b c d e f g h i j k l m n o p q r s t u v w x y z"
    got = [(r.doc_id, r.component_id) for r in jaccard_join.jaccard_components(frame(spark, [(5, t), (5, t), (7, t), (8, None), (8, None)])).collect()]
    assert sorted(got) == [(5, 5), (5, 5), (7, 5), (8, 8), (8, 8)]


# --- thresholds, surrogates, lexicon --------------------------------------------------------------


def test_sources_get_fences_of_their_own(spark):
    rng = random.Random(3)
    plain = lambda i: " ".join("word%d" % rng.randint(0, 5000) for _ in range(200))
    marked = lambda i: " ".join(("w%d" if rng.random() < 0.7 else "w%d##") % rng.randint(0, 5000) for _ in range(200))
    rows = [(i, plain(i), "en", "prose", 1) for i in range(150)] + [(1000 + i, marked(i), "en", "code", 1) for i in range(150)] + [(5000, marked(0), "en", "prose", 1), (5001, plain(0), None, None, 1), (5002, plain(0), "", "", 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    fences = {(r.lang, r.source): r for r in quality_rules.thresholds(quality_rules.measures(docs)).collect()}
    assert fences["en", "code"].max_symbols > 400 > fences["en", "prose"].max_symbols and {(None, None), ("", "")} <= set(fences)
    kept = {r.doc_id: r.kept for r in quality_rules.quality_rules(docs).collect()}
    assert not kept[5000] and kept[0] and all(kept[1000 + i] for i in range(100))


def test_phones_keep_their_country_and_names_their_family():
    for number, code in (("+493012345678", "+49"), ("+12025550123", "+1"), ("+3531234567", "+353")):
        made = {pii.surrogate("phone", number, a, KEY) for a in range(8)}
        assert all(m.startswith(code) and (a := len(m)) >= len(number) for m in made) and len(made) == 8 and a
    family = lambda kind, name: pii.replacement(kind, name, {}, KEY).split()[-1]
    assert family("name_m", "smith") == family("name_m", "james smith") == family("name_f", "anna smith")
    assert pii.replacement("name_m", "james smith", {}, KEY).split()[0] == pii.replacement("name_m", "james miller", {}, KEY).split()[0]
    assert family("name_f", "иванова") == family("name_m", "иванов") + "а"
    domain = lambda x: pii.replacement("email", x, {}, KEY).partition("@")[2]
    assert domain("a@firm.org") == domain("b.c@firm.org") != domain("a@other.org")


def test_domains_and_given_names_stay_distinct(spark):
    rows = [(i, f"mail a@d{i:03d}.net and Mr {n} Smith") for i, n in enumerate(f"N{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(300))]
    got = {r.doc_id: r.text for r in pii.pseudonymise(frame(spark, rows + [(0, rows[0][1]), (None, "Mr Nobody")]), KEY).collect()}
    parts = [re.fullmatch(r"mail (\S+)@(\S+) and Mr (\w+) (\w+)", got[i]).groups() for i in range(300)]
    assert len({p[1] for p in parts}) == len({p[2] for p in parts}) == 300 and len({p[3] for p in parts}) == 1
    assert not {p[1] for p in parts} & {f"d{i:03d}.net" for i in range(300)}


def test_another_key_gives_other_surrogates(spark):
    docs = frame(spark, [(1, "Mr James Smith, a.b@firm.org")])
    one, two = (pii.pseudonymise(docs, k).first().text for k in (KEY, b"other"))
    assert one != two and one == pii.pseudonymise(docs, KEY).first().text


def test_lexicon_has_no_bounds(spark):
    rng = random.Random(4)
    odd = [f"{'x' * 45}{i}" for i in range(30)]
    rows = [(" ".join([rng.choice("abc") * 3, *rng.sample(odd, 6)]), 1) for _ in range(200)] + [("aaa bbb ccc", 0)] * 200
    lexicon = toxicity.learn_lexicon(spark.createDataFrame(rows, "text string, toxic int"))
    machine = toxicity.automaton(lexicon)
    assert all(toxicity.found_terms(machine, w)[0] for w in odd)
    many = {toxicity.fold(f"w{i}"): 1.0 for i in range(3000)}
    assert len(toxicity.found_terms(toxicity.automaton(many), " ".join(f"w{i}" for i in range(3000)))[0]) == len(many) == 3000


def test_scores_against_a_plain_matcher(spark):
    """The automaton's sums are those of a search for each term, exception phrases left out."""
    lexicon = {" idiot ": 2.0, " stup": 1.0, " trash ": 0.5}
    machine, weights = toxicity.automaton(lexicon), [lexicon[k] for k in sorted(lexicon)]
    for text in ("you idiot", "stupid stupidity", "trash trash can trash", "1d1ot! the trash can", "", "nothing", "idiot " * 50):
        folded = toxicity.fold(text)
        spans = [(m.start(), m.end()) for e in toxicity.EXCEPTIONS for m in re.finditer(f"(?={re.escape(toxicity.fold(e).rstrip() + ' ')})", folded) for m in [re.compile(re.escape(toxicity.fold(e).rstrip() + " ")).match(folded, m.start())]]
        want = 0.0
        for term, w in lexicon.items():
            n = sum(1 for i in range(len(folded)) if folded.startswith(term, i) and not any(a <= i and i + len(term) <= b for a, b in spans))
            want += w * np.log2(1 + n)
        assert abs(toxicity.matched(machine, weights, text)[0] - want) < 1e-9, text


# --- pages ----------------------------------------------------------------------------------------


class _Words(html.parser.HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found = []

    def handle_data(self, data):
        self.found += data.split()


def test_all_words_of_random_pages_are_kept_in_order():
    rng = random.Random(6)
    tags = ["p", "div", "ul", "ol", "li", "b", "i", "span", "h2", "blockquote", "section", "pre", "a", "em"]
    for _ in range(200):
        page, opened = [], []
        for k in range(60):
            r = rng.random()
            if r < 0.35:
                opened.append(rng.choice(tags))
                page.append(f"<{opened[-1]}>")
            elif r < 0.55 and opened:
                page.append(f"</{opened.pop(rng.randrange(len(opened)))}>")
            else:
                page.append(f" w{k} &amp;{k} ")
        plain = _Words()
        plain.feed("".join(page))
        plain.close()
        marks = re.compile(r"(?:(?<=\s)|^)(?:-|\d+\.)(?=\s|$)")
        got = [w for w in marks.sub(" ", html_text.render("".join(page))).split()]
        assert got == plain.found


def test_cells_keep_their_columns():
    page = "<table><tr><td>a<td colspan=2>b<td>c<tr><td rowspan=2>d<td>e<td>f<td>g<tr><td>h<td>i<td>j<tr><td colspan=4>a very long line over all columns</table>"
    lines = html_text.render(page).split("\n")
    column = lambda s, x: s.index(x)
    assert column(lines[0], "c") == column(lines[1], "g") == column(lines[2], "j") and column(lines[1], "e") == column(lines[2], "h") == column(lines[0], "b")
    assert html_text.render("<table><tr><td rowspan=0 colspan=x>a<td rowspan=99999999>b<tr><td>c</table>") == "a  b\nc"


@pytest.mark.parametrize("piece", ["<b>a<div>", "</q>x<i>", "<li>x<ul>", "<svg><g>t", "<p>a", "<table><tr><td>", "<a href='", "<!--", "&#", "<option>x"])
def test_pages_take_linear_time(piece):
    began = time.time()
    html_text.render(piece * 20_000)
    assert time.time() - began < 20


def test_many_exceptions_take_linear_time():
    machine = toxicity.automaton({" trash ": 1.0})
    began = time.time()
    assert toxicity.found_terms(machine, "trash can " * 60_000)[0] == {} and time.time() - began < 10


# --- long texts, empty tables, the pipeline -------------------------------------------------------


def test_very_long_texts(spark, long_text):
    assert len(long_text) > 900_000
    docs = frame(spark, [(1, long_text), (2, long_text), (3, long_text.replace("\n", " ")), (4, "short text of a few words")])
    none, bench = spark.createDataFrame([], LABELS), spark.createDataFrame([(1, " ".join(long_text.split()[500:540]))], "item_id long, text string")
    assert {r.doc_id: r.n_removed for r in line_dedup.dedup_lines(docs).collect()}[2] == 4500
    assert quality_rules.quality_rules(docs).filter("n_words > 100000").count() == 3
    got = {r.doc_id: r for r in suffix_dedup.repeated_spans(docs).collect()}
    assert got[1].n_removed == 0 and got[2].n_removed == len(long_text)
    assert {r.doc_id: r.component_id for r in jaccard_join.jaccard_components(docs, 5, 80).collect()} == {1: 1, 2: 1, 3: 1, 4: 4}
    assert toxicity.toxicity(docs, none).count() == quality_classifier.score_documents(docs, none).count() == 4
    assert {r.doc_id for r in decontaminate.contained_items(docs, bench).collect()} == {1, 2, 3}
    assert pii.pseudonymise(docs, KEY).filter("n_entities = 0").count() == 4
    ids = {r.doc_id: r.ids_sha256 for r in bpe.encoding_digests(docs, bpe.tokenizer_path()).collect()}
    assert ids[1] == ids[2]
    pages = spark.createDataFrame([(1, "u", "<p>" + long_text.replace("\n", "<p>"))], "page_id long, url string, html string")
    assert html_text.extract_text(pages).first().text.split() == long_text.split()


def test_empty_pages_and_pipeline(spark, tmp_path):
    assert html_text.extract_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    frame(spark, []).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], LABELS).write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert pipeline.run(spark, str(tmp_path)).count() == 0


def _line_sets(texts):
    return [(d, p, frozenset(x for x in re.split(r"[ \t\r\f\v]+", line.lower()) if x)) for d, t in texts for p, line in enumerate(t.split("\n"))]


def test_pipeline_against_brute_force(spark, tmp_path, words):
    """All stages but the first, whose labels are none here, so it keeps every document."""
    from tokenizers import Tokenizer

    rng = random.Random(12)
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    item = prose(30)
    base = [f"{prose(40)}\n{prose(30)}" for _ in range(12)]
    rows = [(i, t) for i, t in enumerate([*base, base[3], base[4].replace("\n", " zz\n"), f"{prose(20)} {item} {prose(20)}", f"{base[5]}\n{prose(20)}", None, "", "menu\nMenu\nother"])]
    frame(spark, rows + [(40, None)]).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], LABELS).write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item), (2, "not there")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    texts = [(d, t) for d, t in rows if t is not None]
    lines = _line_sets(texts)
    gone = {(d, p) for i, (d, p, s) in enumerate(lines) if s and any(o and 5 * len(s & o) >= 4 * len(s | o) for _, _, o in lines[:i])}
    left = {d: "\n".join(x for p, x in enumerate(t.split("\n")) if (d, p) not in gone) for d, t in texts}
    grams = {}
    for d, t in left.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", t.lower())
        grams[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    root = {d: d for d in left}
    for a in sorted(left):
        for b in sorted(left):
            if a < b and grams[a] & grams[b] and 100 * len(grams[a] & grams[b]) >= 80 * len(grams[a] | grams[b]):
                x, y = root[a], root[b]
                root = {k: min(x, y) if v in (x, y) else v for k, v in root.items()}
    alnum = lambda t: re.findall(r"[a-z0-9\u0080-\U0010ffff]+", t.lower())
    five = lambda t: {tuple(alnum(t)[i : i + 5]) for i in range(len(alnum(t)) - 4)}
    want = {d: t for d, t in left.items() if root[d] == d and 5 * len(five(item) & five(t)) < 4 * len(five(item))}
    tokenizer = Tokenizer.from_file(bpe.tokenizer_path())
    got = {r.doc_id: r.ids for r in pipeline.run(spark, str(tmp_path)).collect()}
    for d in [d for d, t in rows if t is None] + [40]:
        assert got.pop(d) == []
    assert got == {d: tokenizer.encode(t, add_special_tokens=False).ids for d, t in want.items()}
    assert tx.fresh("id", ["ID", "_id"]) == "__id"


def test_joints_are_repaired_until_they_agree(monkeypatch):
    """With an encoder whose ids depend on what stands next to them, documents still come out as encoded whole."""
    encoder = bpe.Encoder(bpe.tokenizer_path(), words_apart=False)
    text = " ".join(f"word{i}" for i in range(60)).encode()
    cut = [text[i : i + 30] for i in range(0, len(text), 30)]  # in the middle of words
    encoder._learn_chunks(set(cut))
    whole = encoder.plain([text])[0]
    assert b"".join(encoder.chunks[c] for c in cut) != whole
    assert encoder.repaired(cut, list(range(len(cut) - 1))) == whole
    one = [text[:33], text[33:80], text[80:]]
    encoder._learn_chunks(set(one))
    assert encoder.repaired(one, [0, 1]) == whole


def test_texts_of_one_id_are_documents_of_their_own(spark, tmp_path):
    rows = [(0, "alpha beta gamma"), (1, "alpha beta gamma\nzeta one"), (1, "unique words here\nzeta two"), (1, "unique words here\nzeta two"), (1, None)]
    docs = frame(spark, rows).withColumns({"copy": F.lit("own"), "hash": F.lit(4)})
    got = sorted((r.doc_id, r.text or "", r.n_removed) for r in line_dedup.dedup_lines(docs).collect())
    assert got == [(0, "alpha beta gamma", 0), (1, "", 0), (1, "unique words here\nzeta two", 0), (1, "unique words here\nzeta two", 0), (1, "zeta one", 1)]
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    out = registry.QUERIES["op1_line_dedup"](spark, str(tmp_path)).collect()
    assert sorted(tuple(r) for r in out) == [(0, 1, 0, 0), (1, 0, 0, 0), (1, 2, 0, 0), (1, 2, 0, 0), (1, 2, 1, 1)]


@pytest.mark.parametrize("n", [60, 400])
def test_wide_and_deep_spans_cost_what_they_say(n):
    page = "<table><tr>" + "".join(f"<td colspan=1000 rowspan={60_000 - i % 7}>c{i}</td>" for i in range(n)) + "</tr>" + "<tr><td>x</td></tr>" * n + "</table>"
    began = time.time()
    text = html_text.render(page)
    assert time.time() - began < 2 and len(text) <= html_text.PADDING * len(page) + 2 * html_text.FREE_PADDING
    assert text.split("\n")[0].split() == [f"c{i}" for i in range(n)] and text.count("x") == n
    one = html_text.render("<table><tr>" + "<td colspan=1000>q</td>" * 1000 + "</tr></table>")
    assert len(one) < 4000 and one.split() == ["q"] * 1000


def test_cells_keep_their_columns_under_spans():
    page = "<table><tr><td rowspan=2>ab<td colspan=2>wide one<td>z</tr><tr><td>c<td>d<td>e</tr><tr><td>1<td>2<td>3<td>4</tr></table>"
    assert html_text.render(page) == "ab  wide one  z\n    c  d      e\n1   2  3      4"


def test_long_lines_meet_few_others_and_are_hashed_once(spark, monkeypatch):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(400)]
    lines = [rng.sample(vocabulary, 150) for _ in range(300)]
    for k in (60, 61):  # 33 words may differ in all
        lines.append(lines[k][:-8] + [f"new{k}{i}" for i in range(8)])
    found, plans, write = {}, [], tx.written

    def watched(df, name, keep=False):
        out = write(df, name, keep)
        found[name] = found.get(name, 0) + out.count()
        if name == "lines":
            plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return out

    monkeypatch.setattr(tx, "written", watched)
    got = line_dedup.similar_lines(frame(spark, [(i, " ".join(x)) for i, x in enumerate(lines)])).collect()
    assert sorted(r.doc_id for r in got) == [300, 301]
    assert found["wanted"] <= 40 and "sort_array" in plans[0] and plans[0].count("sort_array") == 1


def test_words_of_a_line_are_made_distinct_once_and_fall_on_one_map_each(spark, monkeypatch):
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(150)]
    lines = [rng.choices(vocabulary, weights=range(1, 151), k=rng.choice([1, 3, 4, 9, 20, 47, 90])) for _ in range(150)]
    for x in lines[:60]:
        lines.append([w if rng.random() < 0.9 else rng.choice(vocabulary) for w in x] + [x[0], "", f"new{rng.randrange(20)}"][: rng.randrange(4)])
    rng.shuffle(lines)
    sets = [set(x) - {""} for x in lines]
    plans, write = {}, tx.written

    def watched(df, name, keep=False):
        plans.setdefault(name, df._jdf.queryExecution().optimizedPlan().toString())
        return write(df, name, keep)

    monkeypatch.setattr(tx, "written", watched)
    got = line_dedup.similar_lines(frame(spark, [(i, rng.choice(["  ", " \t", " "]).join(x)) for i, x in enumerate(lines)])).collect()
    want = {i for i, a in enumerate(sets) if any(5 * len(a & b) >= 4 * len(a | b) for b in sets[:i])}
    assert {r.doc_id for r in got} == want and len(want) > 20
    assert "array_distinct" not in plans["lines"] and plans["lines"].count("array_except") == 1
    assert sorted(re.findall(r"\baggregate\((\w+)#", plans["lines"])) == ["common", "rare"]


def test_words_of_a_line_are_hashed_once_for_counters_and_keys(spark, monkeypatch):
    plans, write, levels = {}, tx.written, line_dedup._levels

    def watched(df, name, keep=False):
        plans.setdefault(name, df._jdf.queryExecution().withCachedData().toString())
        return write(df, name, keep)

    def counted(rows):
        plans["counters"] = rows._jdf.queryExecution().withCachedData().toString()
        return levels(rows)

    monkeypatch.setattr(tx, "written", watched)
    monkeypatch.setattr(line_dedup, "_levels", counted)
    docs = frame(spark, [(1, "a b c d e f g h i j\nx"), (2, "A b c d e f g h i J k"), (3, "")])
    assert [(r.doc_id, r.place) for r in line_dedup.similar_lines(docs).collect()] == [(2, 0)]
    assert "InMemoryRelation" in plans["counters"] and "InMemoryRelation" in plans["lines"]
    assert not spark.sparkContext._jsc.getPersistentRDDs()


def test_line_query_shuffles_into_one_file_a_task_and_leaves_the_session_as_it_was(spark, tmp_path, monkeypatch):
    frame(spark, [(1, "a b c d e f g h i j\nx"), (2, "A b c d e f g h i J k"), (3, "")]).write.parquet(str(tmp_path / "documents.parquet"))
    name, seen, write = "spark.sql.shuffle.partitions", set(), tx.written

    def watched(df, table, keep=False):
        seen.add(spark.conf.get(name))
        return write(df, table, keep)

    monkeypatch.setattr(tx, "written", watched)
    old = spark.conf.get(name)
    try:
        for own, inside in ((200, "201"), (8, "8"), (900, "900")):
            seen.clear()
            spark.conf.set(name, own)
            assert sorted(tuple(r) for r in registry.QUERIES["op1_line_dedup"](spark, str(tmp_path)).collect()) == [(1, 2, 0, 0), (2, 1, 1, 1), (3, 1, 0, 0)]
            assert seen == {inside} and spark.conf.get(name) == str(own)
    finally:
        spark.conf.set(name, old)


@pytest.mark.parametrize("num, den", [(4, 5), (2, 3), (1, 2), (9, 10)])
def test_most_words_of_a_partner_are_those_of_the_filters_by_length_and_place(spark, num, den):
    sets = [(n, 0, n, 0, 0, list(range(n - -(-n * num // den) + 1))) for n in range(1, 41)]
    rows = line_dedup._dealt(spark.createDataFrame(sets, "doc_id long, place long, n int, parity long, half long, prefix array<int>"), num, den)
    assert not any(f.nullable for f in rows.schema if f.name != "i")
    found = [(r.n, r.i, r.most) for r in rows.collect()]
    for nx, ix, mx in found:
        for ny, iy, my in found:
            old = den * min(nx, ny) >= num * max(nx, ny) and min(nx - ix, ny - iy) * (num + den) >= num * (nx + ny)
            assert (ny <= mx and nx <= my) == old


def test_tasks_of_the_pipeline_give_their_memory_back(spark, monkeypatch):
    name, said = "spark.sql.execution.arrow.maxRecordsPerBatch", []
    monkeypatch.setattr(tx, "release_memory", lambda: said.append(1))
    batch = pa.RecordBatch.from_pydict({"doc_id": [1, 2], "text": ["a b", None]})
    assert len(list(bpe._units(bpe.tokenizer_path(), True)(iter([batch])))) == 1 and said == [1]
    before = spark.conf.get(name)
    try:
        for given, want in (("10000", "1000"), ("0", "1000"), ("50", "50")):
            spark.conf.set(name, given)
            pipeline.encoded(spark, frame(spark, [(1, "a")]), "")
            assert spark.conf.get(name) == want
    finally:
        spark.conf.set(name, before)


@pytest.mark.parametrize("n", [3, 3000])
def test_tables_of_every_size_are_aligned_alike(n):
    for wide, gap in ((60, 61), (100, 101), (5000, html_text.GAP)):
        page = "<table><tr><td>" + "w" * wide + "<td>b<td>cc<td>d</tr>" + "<tr><td>a<td>b<td>c<td>d</tr>" * n + "</table>"
        head, *rows = html_text.render(page).split("\n")
        assert head == "w" * wide + "  b  cc  d" and rows == ["a" + " " * gap + "b  c   d"] * n


@pytest.mark.parametrize(
    ("text", "names"),
    [
        ("Frau Dr. Müller kam", ["Müller"]), ("Herr Prof. Dr. med. Hans Weber", ["Hans Weber"]), ("Mr. Smith and Mrs Jane Doe", ["Smith", "Jane Doe"]), ("Frau Dr.-Ing. Lena Vogt.", ["Lena Vogt"]),
        ("господин Иванов и госпожа Анна Петрова", ["Иванов", "Анна Петрова"]), ("Κυρία Μαρία Παππά", ["Μαρία Παππά"]), ("Sra. Dra. Carmen Ruiz", ["Carmen Ruiz"]), ("the Mrs said", []), ("Madame Me. Camille Roy", ["Camille Roy"]),
    ],
)
def test_names_behind_chains_of_titles(text, names):
    assert [text[a:b] for a, b, kind, _ in pii.find(text) if kind.startswith("name")] == names


def test_sparse_regression_equals_a_dense_one():
    rng = np.random.default_rng(3)
    x = np.where(rng.uniform(size=(300, 40)) < 0.1, rng.uniform(0.2, 1, (300, 40)), 0)
    y = (rng.uniform(size=300) < 1 / (1 + np.exp(-(x @ rng.normal(size=40) * 2 - 0.5)))).astype(float)
    row, col = np.nonzero(x)
    got = toxicity._ridge_logistic(row, col, x[row, col], y, 40)
    a, w, ridge = np.column_stack([x, np.ones(300)]), np.zeros(41), np.append(np.full(40, 0.05), 1e-6)
    for _ in range(50):
        p = 1 / (1 + np.exp(-a @ w))
        w -= np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + np.diag(ridge), a.T @ (p - y) + ridge * w)
    assert np.allclose(got, w, atol=1e-4)
    assert len(toxicity._ridge_logistic(np.zeros(0, int), np.zeros(0, int), np.zeros(0), np.zeros(0), 2)) == 3
