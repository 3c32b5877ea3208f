"""Source divergence against plain counting, and its SQL."""

import collections
import random
import re

from shopsight.llm import source_divergence as S
from tests import oracle_check

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
SCHEMA = "doc_id long, text string, lang string, source string, n long, docs long, chunk string, term string"


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(rows, least, top=50):
    docs = [(lang or "", source or "", terms(text)) for text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        seen = collections.Counter(t for d in mine for t in set(d[2]))
        kept = sorted(t for t, n in seen.items() if n >= least)
        sources = sorted({d[1] for d in mine})
        counts = {s: collections.Counter(t for d in mine if d[1] == s for t in d[2]) for s in sources}
        counts[None] = sum(counts.values(), collections.Counter())
        share = {s: {t: 1 + 10**9 * (c[t] + 5) // (sum(c[x] for x in kept) + 5 * len(kept)) for t in kept} for s, c in counts.items()}
        for s in sources:
            pairs = [(-sum(abs(share[s][t] - share[o][t]) for t in kept), o.encode()) for o in sources if o != s]
            over = [(share[None][t] - share[s][t], t.encode()) for t in kept if counts[s][t] and share[s][t] > share[None][t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(over)[:top])):
                out += [(lang, s, part, item.decode(), -value, i + 1) for i, (value, item) in enumerate(found)]
    return sorted(out)


def table(rows):
    return [(i % 7, text, lang, source, 1, 2, "x", "y") for i, (text, lang, source) in enumerate(rows)]


def test_divergence_equals_plain_counting(spark):
    draw = random.Random(2)
    stock = ["word", "Word,", "WORD.", "über", "ÜBER", "漢字", "a-b", "x1y", "don't", "e f", " g", "123", "end", "ſ", "K", "z" * 400]
    rows = [(" ".join(draw.choices(stock, k=draw.randint(0, 30))), draw.choice(["en", "de", None]), draw.choice(["a", "b", "ü", None]))
            for _ in range(220)]
    rows += [("only here " * 3, "fr", "a"), ("", "fr", "b"), (None, "it", "c"), (" \t", "en", "blank")] + [("same text", "en", "a")] * 40
    rows += [("tab\tline\x0bfeed\x85next", "en", "b")] * 3
    for least, parts in ((30, 1), (30, 9), (3, 5), (1, 4)):
        frame = spark.createDataFrame(table(rows), SCHEMA).repartition(parts)
        assert sorted(map(tuple, S.divergence(frame, least=least).collect())) == brute(rows, least)


def test_small_holds_and_rare_chunks(spark):
    """Terms whose documents only add up over several rare chunks."""
    rows = [(f"term{'.' * (i % 12)} other{i} Both both, both;", "en", f"s{i % 3}") for i in range(60)]
    frame = spark.createDataFrame(table(rows), SCHEMA).repartition(5)
    assert sorted(map(tuple, S.divergence(frame, least=30).collect())) == brute(rows, 30)
    small = [(f"term{'.' * (i % 12)} other, other; filler{i}", "en", f"s{i % 3}") for i in range(29)]
    frame = spark.createDataFrame(table(small), SCHEMA)
    assert {r[4] for r in S.divergence(frame, least=30).collect()} == {0} and brute(small, 30)


def test_slices_of_documents_add_up(spark):
    """Counts of a few texts at a time, so that most chunks meet in pieces."""
    rows = [(f"term{'.' * (i % 12)} other{i} Both both, both;", ["en", "de"][i % 2], f"s{i % 3}") for i in range(80)]
    frame = spark.createDataFrame(table(rows), SCHEMA).repartition(3).selectExpr(
        "text", "lang", "source", "monotonically_increasing_id() row").cache()
    row = lambda r: (r.lang, r.docs, dict(zip(r.sources, r.ns)), r.terms, r.times)
    few, all_at_once = (sorted((row(r) for r in S._split_chunks(S._chunk_counts(frame, 30, limit), 30).collect()), key=repr)
                        for limit in (40, 1 << 24))
    assert few == all_at_once and sum(n for r in few for n in r[2].values()) == 80 * 5


def test_several_buckets_of_terms(spark, monkeypatch):
    monkeypatch.setattr(S, "BUCKET", 4)
    rows = [(" ".join(f"w{chr(97 + (i * j) % 26)}" for j in range(9)), "en", f"s{i % 4}") for i in range(90)]
    frame = spark.createDataFrame(table(rows), SCHEMA)
    assert sorted(map(tuple, S.divergence(frame, least=3).collect())) == brute(rows, 3)


def test_long_text_and_no_rows(spark):
    rows = [("x" * 2_000_000 + " word " * 200_000, "en", "a"), ("word", "en", "b")]
    frame = spark.createDataFrame(table(rows), SCHEMA)
    assert sorted(map(tuple, S.divergence(frame, least=1).collect())) == brute(rows, 1)
    assert S.divergence(frame.where("false")).collect() == []


def test_sql(spark, sf_dir):
    assert oracle_check.difference(spark, oracle_check.connect(sf_dir), sf_dir, "op12_source_divergence") is None
