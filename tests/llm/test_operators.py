"""Brute-force versions, round trips and odd rows for the corpus operators."""

import hashlib
import os
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from junctura.llm import bpe, decontaminate, graph, html_text, jaccard_join, line_dedup, pii, quality_classifier, quality_rules, suffix_dedup, text as tx, toxicity

KEY = b"a key of the tests"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, n long"


def frame(spark, texts, start=0):
    return spark.createDataFrame([(start + i, t, None if i % 7 == 3 else "en", "s" if i % 5 else None, None if t is None else len(t), 1, 2) for i, t in enumerate(texts)], SCHEMA)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base = [prose(60) + "\n" + prose(25) for _ in range(12)]
    near = [b.replace(" ", " zz ", 1) for b in base[:4]]
    passage = prose(30)
    out = [*base, base[2], base[2], *near, f"{prose(20)} {passage} {prose(15)}", f"{prose(9)} {passage} {prose(30)}", passage, None, "", "   \n\t", "a", "a b", "x" * 3000, "ab " * 800, f"{base[0]}\n{base[1]}", "é" * 60 + passage, "One.\nOne.\n" + base[3]]
    return out


def test_spans_against_brute_force(spark, texts):
    docs = frame(spark, texts)
    for size in ("1000", "4"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        got = {r.doc_id: r for r in suffix_dedup.repeated_spans(docs.repartition(3), frequent=2).collect()}
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    seen: set[bytes] = set()
    for k, t in enumerate(texts):
        raw = (t or "").encode()
        gone, own = bytearray(len(raw)), set()
        for i in range(len(raw) - 49):
            if raw[i : i + 50] in seen:
                gone[i : i + 50] = b"\1" * 50
            own.add(raw[i : i + 50])
        seen |= own
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        spans = sum(1 for i in range(len(raw)) if gone[i] and (i == 0 or not gone[i - 1]))
        r = got[k]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()), k


def _components(sets, num, den):
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]) and sets[a] & sets[b]:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {k: find(k) for k in sets}


@pytest.mark.parametrize(("width", "num"), [(3, 90), (5, 80)])
def test_jaccard_against_brute_force(spark, texts, width, num):
    sets = {}
    for k, t in enumerate(texts):
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
        sets[k] = {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()
    got = {r.doc_id: r for r in jaccard_join.jaccard_components(frame(spark, texts), width, num, 100).collect()}
    want = _components(sets, num, 100)
    assert {k: (len(s), want[k]) for k, s in sets.items()} == {k: (r.n_shingles, r.component_id) for k, r in got.items()}


def test_components_that_do_not_settle_are_an_error(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(20)], "a long, b long")
    assert {r.component for r in graph.components(edges).collect()} == {0}
    with pytest.raises(RuntimeError, match="rounds"):
        graph.components(edges, max_rounds=1)


def test_bands_hold_every_partner():
    uppers = jaccard_join.bands(5000, 90, 100)
    for size in range(1, 4000):
        i = np.searchsorted(uppers, size)
        assert np.searchsorted(uppers, size * 100 // 90) <= i + 1


def test_lines_against_brute_force(spark, texts):
    rows = [t for t in texts]
    lines = [(d, p, frozenset(x for x in re.split(r"[ \t\r\f\v]+", line.lower()) if x)) for d, t in enumerate(rows) if t is not None for p, line in enumerate(t.split("\n"))]
    lines = [x for x in lines if len(x[2]) >= 5]
    want = {(d, p) for i, (d, p, s) in enumerate(lines) if any(5 * len(s & o) >= 4 * len(s | o) for _, _, o in lines[:i])}
    got = {(r.doc_id, r.place) for r in line_dedup.similar_lines(frame(spark, rows), min_words=5).collect()}
    assert got == want
    kept = {r.doc_id: r.text for r in line_dedup.dedup_lines(frame(spark, rows), min_words=5).collect()}
    assert kept[0] == rows[0] and kept[12] == "" and kept[len(texts) - 1].startswith("One.\nOne.")


def test_short_lines_against_brute_force(spark, texts):
    import corpus_pipeline as pipeline

    rows = [*texts, "Home\nHOME\nhome page\nHome", "a b c d\na b c d e\na b c\nb a", "a a a b b c\n\nc b a\ne d c b a", "Kind regards\nd c b x\nx b c d y\nkind  regards"]
    lines = [(d, p, frozenset(x for x in re.split(r"[ \t\r\f\v]+", line.lower()) if x)) for d, t in enumerate(rows) if t is not None for p, line in enumerate(t.split("\n"))]
    lines = [x for x in lines if x[2]]
    want = {(d, p) for i, (d, p, s) in enumerate(lines) if any(5 * len(s & o) >= 4 * len(s | o) for _, _, o in lines[:i])}
    docs = frame(spark, rows)
    assert {(r.doc_id, r.place) for r in line_dedup.similar_lines(docs).collect()} == want
    # the stage of the pipeline judges them, too
    kept = {r.doc_id: r.text for r in pipeline.distinct_lines(spark, docs, "").collect()}
    assert kept == {d: None if t is None else "\n".join(x for p, x in enumerate(t.split("\n")) if (d, p) not in want) for d, t in enumerate(rows)}
    assert kept[len(texts)] == "Home\nhome page" and kept[len(texts) + 3] == "Kind regards\nd c b x"


def test_encoding_equals_the_library(spark, texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(bpe.tokenizer_path())
    odd = [*texts, "it's A.B, c!. d_. <|endoftext|> x y é İ", "Σς ß 日本 12,3 " * 40]
    got = {r.doc_id: r for r in bpe.encode_decode(frame(spark, odd), bpe.tokenizer_path()).collect()}
    for k, t in enumerate(odd):
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids
        assert got[k].ids == ids and got[k].decoded == tokenizer.decode(ids, skip_special_tokens=False)


def test_contained_items_against_brute_force(spark, texts):
    items = [" ".join(texts[i].split()[5:45]) for i in range(5)] + ["a b", "a", None, "", "not there at all in any of these texts"]
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(items)], "item_id long, text string")
    words = lambda t: re.findall(r"[a-z0-9\u0080-\U0010ffff]+", (t or "").lower())
    want = set()
    for i, item in enumerate(items):
        w = words(item)
        n = min(5, len(w))
        grams = {tuple(w[j : j + n]) for j in range(len(w) - n + 1)} if w else set()
        for d, t in enumerate(texts):
            x = words(t)
            have = {tuple(x[j : j + n]) for j in range(len(x) - n + 1)} if n else set()
            if grams and 5 * len(grams & have) >= 4 * len(grams):
                want.add((d, i))
    got = {(r.doc_id, r.item_id) for r in decontaminate.contained_items(frame(spark, texts), bench, block=30).collect()}
    assert got == want and want


def test_surrogates_are_distinct_and_alike(spark):
    rows = [f"Mail u{i}.{i:02d}@mail{i % 9}.example.com or call +1 ({200 + i}) 555-{1000 + i}, at 10.{i}.3.4, card 4{i:015d}" for i in range(60)]
    rows += [rows[0].upper(), "Mrs. Anna Smith met Herr Müller and MRS. nobody", None, "", "no data"]
    got = {r.doc_id: r for r in pii.pseudonymise(frame(spark, rows), KEY).collect()}
    emails = [re.findall(r"\S+@\S+", got[i].text)[0] for i in range(60)]
    assert len(set(emails)) == 60 and not set(emails) & {re.findall(r"\S+@\S+", rows[i])[0] for i in range(60)}
    assert all(len(a) == len(re.findall(r"\S+@\S+", rows[i])[0]) for i, a in enumerate(emails))
    assert re.findall(r"\S+@\S+", got[60].text)[0] == emails[0].upper()
    assert got[60].n_entities == 4 and got[62].text is None and got[63].text == "" and got[64].text == "no data"
    assert re.fullmatch(r"Mrs\. \w+ \w+ met Herr \w+ and MRS\. nobody", got[61].text) and "Smith" not in got[61].text


def test_surrogates_outgrow_a_small_space(spark, monkeypatch):
    letters = "abcdefghijklmnopqrstuvwxyz"
    alphabet = "αβγδεζηθικλμνξοπρστυφχψω"
    names = ["Ω" + alphabet[i // 576 % 24] + alphabet[i // 24 % 24] + alphabet[i % 24] for i in range(4500)]
    rows = [*[f"write to {c}@example.com" for c in letters], "\n".join(f"Herr {x}." for x in names), "token: !!!!!!!!"]
    got = {r.doc_id: r.text for r in pii.pseudonymise(frame(spark, rows), KEY).collect()}
    emails = {got[i].split()[-1] for i in range(26)}
    assert len(emails) == 26 and not emails & {f"{c}@example.com" for c in letters}
    made = [x[5:-1] for x in got[26].split("\n")]
    assert len(set(made)) == len(names) > 16**3 and not set(made) & set(names)
    assert "!" not in got[27]
    monkeypatch.setattr(pii, "MAX_ATTEMPTS", 1)
    with pytest.raises(RuntimeError, match="surrogate"):
        pii.pseudonymise(frame(spark, rows[:26]), KEY)


def test_grown_surrogates_keep_their_format():
    assert pii.formatted("phone", "(030) 123-4567", pii.surrogate("phone", "0301234567", pii.GROW, KEY)).startswith("(") and len(pii.surrogate("phone", "0301234567", pii.GROW, KEY)) == 11
    assert len(pii.formatted("phone", "030 123-4567", "03012345678")) == len("030 123-4567") + 1
    assert len(pii.surrogate("secret", "abcdef01", 2 * pii.GROW, KEY)) == 10 and len(pii.surrogate("surname", "王", pii.GROW, KEY)) == 2


def test_card_surrogates_keep_the_check_digit():
    assert pii.luhn("4111111111111111") and pii.luhn(pii.surrogate("card", "4111111111111111", 0, KEY))
    assert pii.surrogate("card", "4111111111111111", 0, KEY) != pii.surrogate("card", "4111111111111111", 1, KEY)


def test_pages():
    page = "<html><head><title>t</title></head><body><ul><li>A<li>B<ul><li>c</ul></ul><p>one <b>two<p>three<br>four <div hidden>no</div><table><tr><th>Name<th>N<tr><td>long name<td>1</table><pre> a\n  b</pre>x &amp; y<script>1<2</script><!-- z -->"
    assert html_text.render(page) == "- A\n- B\n  - c\n\none two\n\nthree\nfour\n\nName       N\nlong name  1\n\n a\n  b\n\nx & y"
    for bad in ("", "<", "<a", "</p>", "<table><td>x", "<li>" * 50, "<p style='display:none'>a<p>b", "a<b"):
        html_text.render(bad)
    assert html_text.render("<p style='display:none'>a<p>b") == "b"


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<p>so <math><mi>x</mi><mo>=</mo><mn>1</mn><annotation>x=1</annotation></math> holds</p>", "so x=1 holds"),
        ("<svg><title/><defs><text>no</text></defs>no<text>Jan</text><g><text>Feb</text></g></svg><p>after", "Jan\nFeb\n\nafter"),
        ("<i>a<svg viewBox='0'/>b</i>", "ab"),
        ("<svg><path d='M0'><p>out of it", "out of it"),
        ("<p>Land: <select><option>A<option selected>B &amp; C<option>D</select> end", "Land: B & C end"),
        ("<p>x <select><option disabled>no<option>first<option>no</select>", "x first"),
        ("<select><option hidden selected>Choose<option>no</select>", "Choose"),
        ("<select multiple><optgroup label=G><option>A<option label=L>B</select>z", "G\nA\nL\nz"),
        ("a<textarea>\n1 <b>\n  2 &lt;</textarea>b", "a\n1 <b>\n  2 <\nb"),
        ("a<xmp>x <b>&amp;</b></xmp>b", "a\n\nx <b>&amp;</b>\n\nb"),
        ("a <i aria-hidden=true>b</i>", "a b"),
        ("<object>shown</object><object data=x>not</object>", "shown"),
        ('<div class="a"">Visible text</div><p>more</p>', "Visible text\n\nmore"),
        ("<div title=don't>one</div><p>it's</p>", "one\n\nit's"),
        ('<a title="x > y" href=\'>\'>z</a><i a = "<b>">q</i>', "zq"),
        ("<details>no<summary>Head</summary>no<p>no<summary>no</summary></details>x", "Head\nx"),
        ("<details open><summary>Head</summary>yes</details>x", "Head\nyes\nx"),
        ("<div hidden><details><summary>no</summary></details></div>a<details><p>no</details>b", "a\nb"),
        ("<details><summary>A</summary><details><summary>no</summary>no</details></details>b", "A\nb"),
    ],
)
def test_only_what_is_not_painted_is_left_out(page, want):
    assert html_text.render(page) == want


def test_pages_with_odd_rows(spark):
    df = spark.createDataFrame([(1, "u", None), (2, None, ""), (3, "u", "<p>a</p>"), (3, "u", "<p>a</p>")], "page_id long, url string, html string")
    assert sorted((r.page_id, r.text) for r in html_text.extract_text(df).collect()) == [(1, ""), (2, ""), (3, "a"), (3, "a")]


def test_rules_on_odd_rows(spark, texts):
    got = {r.doc_id: r for r in quality_rules.quality_rules(frame(spark, texts)).collect()}
    assert len(got) == len(texts)
    assert got[17 + 4].base_failed and not got[0].base_failed
    many = got[[i for i, t in enumerate(texts) if t and t.startswith("ab ab")][0]]
    assert many.n_repeat_words == many.n_words == 800 and many.base_failed and not many.kept


def test_folding():
    assert toxicity.fold("1d1ot!").split() == toxicity.fold("IDIOT").split()
    assert toxicity.fold("ѕtuріd") == toxicity.fold("stupid")
    machine = toxicity.automaton({" trash ": 1.0})
    assert toxicity.matched(machine, [1.0], "you trash") == (1.0, 3) and toxicity.matched(machine, [1.0], "the trash can")[0] == 0.0


def test_held_out_accuracy(spark, sf_dir):
    d = os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.01")  # the smallest tables have too few labels
    docs, labels = tx.table(spark, d, "documents"), tx.table(spark, d, "labels")
    scored = toxicity.toxicity(docs, labels).join(labels, "doc_id").filter("held_out").collect()
    assert np.mean([r.predicted == r.toxic for r in scored]) > 0.93
    judged = quality_classifier.score_documents(docs, labels).join(labels, "doc_id").collect()
    assert np.mean([r.kept == bool(r.quality) for r in judged]) > 0.95


def test_without_labels(spark, texts):
    docs = frame(spark, texts)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in toxicity.toxicity(docs, none).collect()} == {0.5}
    assert docs.count() == quality_classifier.score_documents(docs, none).filter("kept").count()


def test_empty_tables(spark):
    docs, bench = spark.createDataFrame([], SCHEMA), spark.createDataFrame([], "item_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert suffix_dedup.repeated_spans(docs).count() == 0
    assert jaccard_join.jaccard_components(docs).count() == 0
    assert line_dedup.dedup_lines(docs).count() == 0
    assert decontaminate.contained_items(docs, bench).count() == 0
    assert quality_rules.quality_rules(docs).count() == 0
    assert pii.pseudonymise(docs, KEY).count() == 0
    assert bpe.encoding_digests(docs, bpe.tokenizer_path()).count() == 0
    assert toxicity.toxicity(docs, labels).count() == 0
    assert quality_classifier.score_documents(docs, labels).count() == 0


def test_pipeline_keeps_what_each_stage_should(spark, sf_dir):
    import corpus_pipeline as pipeline

    d = sf_dir
    docs = tx.table(spark, d, "documents")
    for name, stage in pipeline.STAGES:
        out = tx.written(stage(spark, docs, d), "stage")
        before, after = ({r.doc_id for r in x.select("doc_id").collect()} for x in (docs, out))
        assert after <= before and len(after) >= 0.6 * len(before), name
        if stage is pipeline.distinct_lines or stage is pipeline.encoded:
            assert after == before
        if stage is pipeline.one_of_each_group:
            found = {r.doc_id: r.component_id for r in jaccard_join.jaccard_components(docs, pipeline.WIDTH, pipeline.SIMILAR, 100).collect()}
            assert after == {k for k, c in found.items() if k == c}
        docs = out
    assert F is not None and docs.columns == ["doc_id", "n_tokens", "ids", "decoded_sha256"]
