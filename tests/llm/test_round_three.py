"""Filter audit, tokenizer alignment and the quality classifier against brute force and held-out labels."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from docwright.llm import cross_align, filter_audit, pairwise_quality, queries

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
DDL = "doc_id long, text string, lang string, source string, n long, good string, mask string, row string, x string, held_out string, pairs string"
LONG = "word tail. " * 30_000
TEXTS = [
    None, "", " \n\t ", "a", "a b c", "a b c", "ab ", "  ab  cd \x0b z", "é" * 70_000, LONG, LONG, "x" * 100_000, "don't  we'll\t\tgo\r\n 123 四五 ١٢ ½ 😀😀", "a▁b", "▁", "<s> hi </s><unk>",
    "<|endoftext|> hi <|endoftext|>  \n\n  there", "<0x41> and <0x0A>", "A B C D", "same words " * 150, "one two three " * 80, "\x1c\x1d\x85​", "# heading | cell", "\x00 nul", "trailing   ",
]


def rows_of(texts):
    return [(i, t, None if i % 5 == 4 else "en" if i % 2 else "", f"s{i % 3}", 7, "x", "y", "z", "w", "v", "p") for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def hard(spark):
    extra = [(3, "a", "en", *["q"] * 1, 7, *["c"] * 6), (None, "a", "en", "s", 7, *["c"] * 6), (None, "a", "en", "s", 7, *["c"] * 6), (4, "a b c", "en", "s", 7, *["c"] * 6)]
    return spark.createDataFrame(rows_of(TEXTS) + extra, DDL).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DDL)


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(i, i % 2, 1 if i % 3 == 0 else None) for i in range(0, 25, 2)] + [(3, 1, 0), (3, 0, 1), (3, None, None), (None, 1, 1), (900, 1, 1)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


# ---- filter audit


def brute_steps(documents, labelled):
    """Every order applied to every document, one by one."""
    good, toxic = ({i for i, *v in labelled if v[k] == 1 and i is not None} for k in (0, 1))
    ids = collections.defaultdict(list)
    for i, t, _ in documents:
        if i is not None:
            ids[t or ""].append(i)
    failed = collections.defaultdict(list)
    for i, t, lang in documents:
        t = t or ""
        w = WORD.findall(t)
        f = {
            "A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": re.search(r"[#$%&*|]", t) is not None,
            "E": i is not None and min(ids[t]) < i,
        }
        failed[lang or ""].append((f, i in good, i in toxic))
    out = set()
    for part, rows in failed.items():
        removed, found = collections.Counter(), []
        for order in itertools.permutations("ABCDE"):
            left = rows
            for step, f in enumerate(order):
                gone = [r for r in left if r[0][f]]
                left = [r for r in left if not r[0][f]]
                removed[f] += len(gone)
                redundant = sum(r[0][f] and any(r[0][x] for x in order[:step]) for r in rows)
                unique = sum(r[0][f] and sum(r[0].values()) == 1 for r in rows)
                found.append((part, "".join(order), step + 1, len(left), len(gone), redundant, unique, sum(r[1] for r in gone), sum(r[2] for r in gone), f))
        out |= {(*r[:-1], removed[r[-1]]) for r in found}
    return out


def test_audit_equals_every_order_applied(hard, docs, labels, spark):
    for d, known in ((hard, labels), (docs, spark.read.parquet(f"{SF}/labels.parquet"))):
        got = filter_audit.audit(filter_audit.mask_counts(d, known)).collect()
        want = brute_steps([(r.doc_id, r.text, r.lang) for r in d.collect()], [(r.doc_id, r.quality, r.toxic) for r in known.collect()])
        assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_plain_changes_reach_every_order_once():
    for n in range(1, 6):
        order = list(range(n))
        seen = [tuple(order)]
        for k in filter_audit.plain_changes(n):
            order[k], order[k + 1] = order[k + 1], order[k]
            seen.append(tuple(order))
        assert sorted(seen) == sorted(itertools.permutations(range(n)))


def test_diagram_keeps_its_counts_over_swaps():
    r = random.Random(2)
    counts = {m: (r.randrange(9), r.randrange(5), r.randrange(3)) for m in range(32) if r.random() < 0.6}
    diagram = filter_audit.Diagram(dict(counts), 5)
    total = diagram.weight[diagram.root]
    for _ in range(200):
        diagram.swap(r.randrange(4))
        assert diagram.weight[diagram.root] == total
        # every mask's path through the diagram ends at its own counts, and no two nodes of a level are the same but for the swapped one above
        for mask in range(32):
            node = diagram.root
            for k, v in enumerate(diagram.order):
                node = diagram.levels[k][node][mask >> v & 1]
            assert diagram.weight[node] == counts.get(mask, (0, 0, 0))


def test_audit_of_an_empty_table_and_of_empty_labels(empty, hard, labels):
    assert filter_audit.audit(filter_audit.mask_counts(empty, labels)).collect() == []
    got = filter_audit.audit(filter_audit.mask_counts(hard, labels.limit(0))).collect()
    assert len(got) == 600 * 2 and all(r.good_lost == r.toxic_lost == 0 for r in got)


def test_audit_of_a_third_in_one_text_moves_few_rows(spark):
    rows = spark.range(30_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot text").otherwise(F.concat(F.lit("t "), "id")).alias("text"), F.lit("en").alias("lang"))
    counts = filter_audit.mask_counts(rows, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert {(r.mask, r.n) for r in counts.collect()} == {(1, 20_001), (17, 9_999)}


# ---- alignment


def brute_links(documents):
    """Groups and links by the libraries over whole texts, and counts by plain dictionaries."""
    import sentencepiece
    from tokenizers import Tokenizer

    json_path, _, model_path = cross_align.paths(None, None, None)
    a, b = Tokenizer.from_file(json_path), sentencepiece.SentencePieceProcessor(model_file=model_path)
    a.encode_special_tokens = True
    back = cross_align.byte_chars()
    a_bytes = lambda i: bytes(back[c] for c in a.id_to_token(i))
    b_bytes = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    found, count = [], collections.Counter()
    for i, t in documents:
        ids = [], []
        if t:
            ids = a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)
            parts = [a_bytes(x) for x in ids[0]], [b_bytes(x) for x in ids[1]]
            if any(b"".join(p) != (" " + t).encode() for p in parts):
                ids = [], []
        ends = [dict(zip(itertools.accumulate(map(len, p)), range(len(p)), strict=True)) if x else {} for p, x in zip(parts if t else ([], []), ids, strict=True)]
        common = sorted(ends[0].keys() & ends[1].keys())
        links = [(ids[0][ends[0][e]], ids[1][ends[1][e]]) for e in common]
        groups, at = [], [0, 0]
        for e in common:
            cut = [ends[k][e] + 1 for k in (0, 1)]
            groups.append("|".join(",".join(map(str, ids[k][at[k] : cut[k]])) for k in (0, 1)))
            at = cut
        found.append((i, len(ids[0]), len(ids[1]), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""))
        count.update(links)
    most = collections.Counter()
    for (x, y), n in count.items():
        most[y] = max(most[y], n)
    return sorted(
        [(i, na, nb, len(ls), len(ls), sum(count[p] == most[p[1]] for p in ls), sum(count[p] for p in ls), h) for i, na, nb, ls, h in found], key=repr
    )


def test_links_equal_the_libraries_over_whole_texts(docs, hard):
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    for d in (docs, hard):
        got = cross_align.link_counts(d, ["doc_id"])
        assert got.columns == names
        want = brute_links([(r.doc_id, r.text) for r in d.select("doc_id", "text").collect()])
        assert sorted([tuple(r) for r in got.collect()], key=repr) == want


def test_units_give_the_ids_of_whole_texts():
    import sentencepiece
    from tokenizers import Tokenizer

    given = cross_align.paths(None, None, None)
    both = cross_align.sides(*given)
    whole, model = Tokenizer.from_file(given[0]), sentencepiece.SentencePieceProcessor(model_file=given[2])
    whole.encode_special_tokens = True
    r = random.Random(7)
    for _ in range(1500):
        t = "".join(r.choice("  theingab\n\t▁é四😀<>s|\x1c\x85\xa0\u3000\r'!") for _ in range(r.randrange(1, 50)))
        got = both.ids(" " + t)
        assert (got is None) == ("▁" in t)
        if got:
            assert both.a.ranks is not None
            assert [x.tolist() for x in got] == [whole.encode(" " + t, add_special_tokens=False).ids, model.encode(t)]


def test_overlaps_are_all_pairs_whose_ranges_meet(hard):
    texts = [(r.doc_id, r.text) for r in hard.select("doc_id", "text").collect() if r.text and len(r.text) < 5000]
    has, left, right, (at_a, at_b) = cross_align.aligned([t for _, t in texts], cross_align.sides(*cross_align.paths(None, None, None)))
    want = {
        (i, j) for i in range(len(left.doc)) for j in range(len(right.doc))
        if left.start[i] < right.end[j] and right.start[j] < left.end[i] and left.doc[i] == right.doc[j]
    }
    assert len(at_a) == len(want) and set(zip(at_a.tolist(), at_b.tolist(), strict=True)) == want
    assert [t for (_, t), ok in zip(texts, has, strict=True) if not ok] == [t for _, t in texts if "▁" in t]


def test_align_lists_pairs_by_document(hard):
    got = cross_align.align(hard.filter("length(text) < 5000"), ["doc_id"]).collect()
    by_doc = collections.defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
    together = {i: sum(r.ends_together for r in rows) for i, rows in by_doc.items()}
    digest = {r.doc_id: r.n_links for r in cross_align.documents(hard.filter("length(text) < 5000"), ["doc_id"]).collect()}
    for i in (1, 2, 6, 7, 12, 16, 24):
        assert together.get(i, 0) == digest[i]
        rows = sorted(by_doc[i], key=lambda r: (r.a_at, r.b_at))
        assert not rows or (rows[0].a_at, rows[0].b_at, rows[0].group_at) == (0, 0, 0) and rows[-1].group_at == digest[i] - 1


def test_alignment_of_an_empty_table_and_clashing_names(empty, hard):
    assert cross_align.link_counts(empty, ["doc_id"]).collect() == []
    assert cross_align.align(empty, ["doc_id"]).collect() == []
    got = cross_align.link_counts(hard.filter("doc_id < 8").withColumnRenamed("good", "N_A"), ["doc_id", "row", "pairs", "N_A"])
    assert got.columns[:4] == ["doc_id", "row", "pairs", "n_a"] and got.count() == 10


def test_pairs_stay_within_the_bytes_of_the_vocabularies(docs):
    both = cross_align.sides(*cross_align.paths(None, None, None))
    a, b = both.a, both.b
    pairs = cross_align.pair_counts(cross_align.documents(docs, ["doc_id"])).collect()
    for r in pairs:
        x, y = a.words[r.pair >> 32], b.words[r.pair & (2**32 - 1)]
        assert x.endswith(y) or y.endswith(x)
    assert len(pairs) <= a.lengths.sum() + b.lengths.sum()


# ---- quality classifier


def is_held_out(i):
    return zlib.crc32(b"" if i is None else str(i).encode()) % 5 == 0


@pytest.fixture(scope="module")
def judged(spark):
    sf = "/root/testdata/sf0.01"
    return {r.doc_id: r for r in queries.op13_quality_classifier(spark, sf).collect()}, spark.read.parquet(f"{sf}/labels.parquet").collect()


def test_scores_tell_held_out_labels_apart(judged):
    got, known = judged
    assert all(r.held_out == is_held_out(i) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for i, r in got.items())
    out = [(got[r.doc_id].score, r.quality, got[r.doc_id].predicted) for r in known if is_held_out(r.doc_id)]
    good, bad = ([s for s, q, _ in out if q == k] for k in (1, 0))
    assert len(good) > 20 and len(bad) > 5
    assert np.mean([[g > b for b in bad] for g in good]) > 0.98
    assert np.mean([p == q for _, q, p in out]) > 0.95


def test_held_out_labels_and_other_columns_change_nothing(spark, judged):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("lang", F.lit("xx")).withColumn("source", F.lit(None).cast("string"))
    known = spark.read.parquet(f"{sf}/labels.parquet")
    flipped = known.withColumn("quality", F.when(pairwise_quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    got = {r.doc_id: r.score for r in pairwise_quality.classify(docs, flipped, ["doc_id"]).collect()}
    assert got == {i: pytest.approx(r.score, abs=1e-9) for i, r in judged[0].items()}


def test_fit_finds_the_direction_and_the_quantile():
    r = np.random.default_rng(0)
    x = r.normal(size=(4000, 3))
    good = 2 * x[:, 0] - x[:, 1] + r.normal(size=4000) * 0.3 > -1
    w, shift = pairwise_quality.fit(x, good, float(good.sum()), float((~good).sum()))
    assert w[0] > 0 > w[1] and abs(w[0] / w[1] + 2) < 0.2 and abs(w[2]) < 0.1 * w[0]
    below = (x @ w + shift < np.log(0.3 / 0.7)).sum()
    assert below == (~good).sum()
    # a sample with one class over-represented is weighed back to the labels' shares
    _, moved = pairwise_quality.fit(x, good, float(good.sum()), 10.0 * (~good).sum())
    assert moved < shift


def test_classifier_on_hard_rows(spark, hard, empty, labels):
    got = pairwise_quality.classify(hard, labels, ["doc_id", "x", "HELD_OUT", "row"])
    assert got.columns == ["doc_id", "x", "row", "held_out", "score", "predicted"]
    rows = got.collect()
    assert len(rows) == hard.count() and all(0 <= r.score <= 1 and r.held_out == is_held_out(r.doc_id) for r in rows)
    assert pairwise_quality.classify(empty, labels, ["doc_id"]).collect() == []
    for known in (labels.limit(0), labels.filter("quality = 1")):
        assert {(r.score, r.predicted) for r in pairwise_quality.classify(hard, known, ["doc_id"]).collect()} == {(0.5, 1)}


def test_sample_is_bounded_by_class_and_ids_that_repeat(spark):
    known = spark.range(4000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("quality"), F.lit(0).alias("toxic"))
    sample = pairwise_quality.label_sample(known, 50).collect()
    assert collections.Counter(r.quality for r in sample) == {0: 50, 1: 50}
    assert {r.n_class for r in sample if r.quality == 0} == {sum(not is_held_out(i) for i in range(0, 4000, 2))}
    assert not any(is_held_out(r.doc) for r in sample)
    docs = spark.range(3000).select((F.col("id") % 10).alias("doc_id"), F.concat(F.lit("some words here "), "id").alias("text"))
    got = pairwise_quality.classify(docs, known, ["doc_id"], size=20)
    assert got.count() == 3000


def test_every_label_is_learnt_from(spark, monkeypatch):
    def none(*_):
        raise AssertionError("a sample was taken")

    monkeypatch.setattr(pairwise_quality, "label_sample", none)
    sf = "/root/testdata/sf0.01"
    known = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if not is_held_out(r.doc_id)}
    got = pairwise_quality.classify(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"), ["doc_id"]).collect()
    scores = [r.score for r in got if r.doc_id in known]
    assert sum(s < 0.3 for s in scores) == sum(q == 0 for q in known.values())


def test_all_rows_stand_in_pairs(spark):
    for n_bad, n_good in ((3, 11), (12, 5)):
        met = spark.createDataFrame([(int(i >= n_bad), [float(i)]) for i in range(n_bad + n_good)], "quality int, x array<double>")
        rows = pairwise_quality.pairs(met, n_bad, n_good).collect()
        most = max(n_bad, n_good) * pairwise_quality.PAIRS
        assert sorted(r.n for r in rows) == list(range(most))
        assert sum(r.d[0] for r in rows) > 0
