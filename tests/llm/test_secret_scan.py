"""Secret scans against regular expressions, and the battery on tokens of known kinds."""

import base64
import math
import random
import re
import string

import pytest
from pyspark.sql import functions as F

from shopsight.llm import secret_scan as S

ASSIGN = re.compile(r'''(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)''', re.I | re.A)
SCHEMA = "doc_id long, text string, row string, kind int, token string, found string"


def base(text):
    text = text or ""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return found


def listed(found):
    return ",".join(f"{S.KINDS[k]}:{s}:{e}" for s, k, e in sorted(found))


PIECES = ["password", "PassWd", "ſecret", "secret", "token", "api_key", "APIKEY", '"', "'", " ", "  ", ":", "=", ": ", "abc", "abcdefgh",
          "a.b/c+d=e_f-g", "AKIA", "AKIA1234567890AB", "AKIAAKIA", "Z9" * 7, "0123456789abcdef", "deadbeef" * 4, "é", "😀", "\n", ",", "x"]


def test_base_spans_equal_regular_expressions(spark):
    draw = random.Random(4)
    texts = ["".join(draw.choices(PIECES, k=draw.randint(0, 40))) for _ in range(700)] + [None, "", "secret: token", "token=" * 9]
    rows = [(None if i % 50 == 0 else i % 300, t, "r", 1, "t", "f") for i, t in enumerate(texts)]
    found = S.secrets(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()
    assert len(found) == len(rows)
    want = sorted((repr(i), listed(base(t)), *[sum(k == kind for _, k, _ in base(t)) for kind in range(3)]) for i, t, *_ in rows)
    assert sorted((repr(r.doc_id), r.base_spans, r.n_assign, r.n_access, r.n_hex) for r in found) == want
    for r in found:
        assert set(filter(None, r.base_spans.split(","))) <= set(r.spans.split(","))


@pytest.fixture(scope="module")
def judged(spark):
    """Many words, identifiers and sequences, and 40 random tokens of each of several encodings."""
    draw = random.Random(9)
    syllables = ["ing", "er", "tion", "ou", "th", "en", "re", "le", "ment", "an", "qu", "st", "pro", "com", "ver"]
    plain = {"".join(draw.choices(syllables, k=draw.randint(8, 16))) for _ in range(3000)}
    plain |= {"".join(s.title() for s in draw.choices(syllables, k=draw.randint(8, 16))) for _ in range(1500)}
    plain |= {"_".join(draw.choices(syllables, k=draw.randint(8, 12))) for _ in range(1500)}
    plain |= {"2024" + f"{draw.randint(1, 12):02d}" * 8 + str(i) for i in range(500)}
    plain |= {string.ascii_letters, string.digits * 4, (string.ascii_lowercase + string.digits) * 2, "A" * 40, "ab" * 30, "AZ09" * 10, "-" * 30}
    plain = {t for t in plain if len(t) >= 20}
    keys = {"".join(draw.choices(string.ascii_letters + string.digits, k=n)) for n in (24, 32, 40, 64) for _ in range(40)}
    keys |= {base64.b64encode(draw.randbytes(n)).decode().rstrip("=") for n in (24, 48, 66) for _ in range(40)}
    keys |= {base64.urlsafe_b64encode(draw.randbytes(45)).decode() for _ in range(40)}
    texts = [f"see {t} there" for t in sorted(plain | keys)]
    rows = S.secrets(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    return {texts[r.doc_id][4:-6]: r.spans for r in rows}, plain, keys


def test_battery_finds_random_tokens_and_leaves_words(judged):
    found, plain, keys = judged
    caught = {t for t in keys if "random" in found[t]}
    false = [t for t in plain if "random" in found[t]]
    long = {t for t in keys if len(t) >= 40}
    assert len(caught & long) >= 0.97 * len(long)
    assert len(caught) >= 0.85 * len(keys)  # of 24 symbols some look no more even than a word may
    assert len(false) <= 0.05 * len(caught), false[:5]
    assert all(found[t] == f"random:4:{4 + len(t)}" for t in keys if found[t].startswith("random"))


def test_structured_tokens_are_never_random(judged):
    found, plain, _ = judged
    for token in (string.ascii_letters, string.digits * 4, (string.ascii_lowercase + string.digits) * 2, "A" * 40, "ab" * 30):
        assert "random" not in found[token], token


def test_statistics_of_the_battery(spark):
    draw = random.Random(1)
    tokens = ["".join(draw.choices(symbols, k=n)) for symbols in ("0123456789", "abcdef0123456789", string.ascii_lowercase,
              string.ascii_letters + string.digits) for n in (20, 41, 300)]
    got = {r.token: r for r in S.battery(spark.createDataFrame([(t,) for t in tokens], "token string")).collect()}
    tail = lambda z: math.erfc(z / math.sqrt(2)) / 2
    for t in tokens:
        _, symbols, index = next(e for e in S.ENCODINGS if re.fullmatch(e[0], t))
        n, k = len(t), len(symbols)
        x = sum((t.count(c) - n / k) ** 2 / (n / k) for c in symbols)
        offset = n * (k * index - 1)
        assert got[t].p == pytest.approx(tail((k - 1 + offset - x) / math.sqrt(2 * (k - 1 + 2 * offset))), rel=1e-3)
        uneven = ((x / (k - 1)) ** (1 / 3) - (1 - 2 / (9 * (k - 1)))) / math.sqrt(2 / (9 * (k - 1)))
        half = [symbols.index(c) >= k // 2 for c in t]
        q = (k // 2) / k
        s2, s3 = q * q + (1 - q) ** 2, q ** 3 + (1 - q) ** 3
        same = sum(a == b for a, b in zip(half, half[1:]))
        runs = (same - (n - 1) * s2) / math.sqrt((n - 1) * (s2 - s2 * s2) + 2 * (n - 2) * (s3 - s2 * s2))
        place = [symbols.index(c) - (k - 1) / 2 for c in t]
        serial = sum(a * b for a, b in zip(place, place[1:])) / ((k * k - 1) / 12 * math.sqrt(n - 1))
        assert got[t].structured == (3 * min(tail(uneven), 2 * tail(abs(runs)), 2 * tail(abs(serial))) < S.STRUCTURED)


def test_false_discovery_rule_is_a_step_up(spark):
    draw = random.Random(6)
    ps = [10 ** draw.uniform(-9, 0) if i % 5 == 0 else draw.random() for i in range(800)]
    rows = [(str(i), i % 2, False, p) for i, p in enumerate(ps)]
    got = {r.token for r in S.discoveries(spark.createDataFrame(rows, "token string, length_class int, structured boolean, p double")).collect()}
    for part in (0, 1):
        mine = sorted(p for i, p in enumerate(ps) if i % 2 == part)
        edge = max((p for i, p in enumerate(mine) if p * len(mine) <= S.FALSE_DISCOVERIES * (i + 1)), default=-1)
        exact = {str(i) for i, p in enumerate(ps) if i % 2 == part and p <= edge}
        mine_got = {t for t in got if int(t) % 2 == part}
        # the histogram's edges can only lose the last half octave
        assert mine_got <= exact and {t for t in exact if ps[int(t)] <= edge / 2} <= mine_got


def test_tokens_within_base_spans_are_no_second_find(spark):
    key = "q7Xw2Zp9Lk4Vb8Nt3Rm6Ys1Hd5Jf0GcT"
    rows = [(1, f"token = {key} and {key}"), (2, f"{key} token={key}")] + [(10 + i, f"{key[i:]}{key[:i]}") for i in range(30)]
    got = {r.doc_id: r.spans for r in S.secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == "assign:0:40,random:45:77" and got[2] == "random:0:32,assign:33:71"


def test_many_matches_in_one_text_and_no_rows(spark):
    text = "token=abcdefgh " * 40_000
    row = S.secrets(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert row.n_assign == 40_000 and row.base_spans == listed(base(text))
    assert S.secrets(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_main_path_has_no_python_worker(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    plan = S.secrets(docs)._jdf.queryExecution().toString() + S.battery(docs.select(F.col("text").alias("token")))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
