"""Conversation structure repair by a run-length dynamic programme in min-plus algebra.

A repaired conversation has the role initials ``(s?(ua)+)?``. Four states follow that language, and every row
is one of nine symbols: its initial (s, u, a or another) without or with a cut-off end, or "must go". A symbol
has a 4 x 4 min-plus matrix of the cheapest edits (insertions before the row included). Equal consecutive
symbols are one run, and a run of n rows is crossed by the cached binary powers of its matrix: costs-to-go are
carried from the last run to the first, then the edits are unrolled from the first row to the last, halving a
run by the same powers. What an edit writes follows from the state, so an audit stands for one repair.

Rows are dealt out by conversation and stream by in order. Of a conversation one byte a row is held (as many
as its audit has), never its texts: a first pass sees faults only, a second one hashes the texts as they pass.

Defined results: a null role or text is one space, in the key of the damage also a null conversation or turn;
rows without a conversation are one conversation. Rows of one turn come by role, then by the MD5 of their text,
so repeated rows are neighbours and all but the first are duplicates. Initials are case-sensitive, and a role
without one (empty) is like any other that the language lacks. Texts of any length stream through. An empty
table gives no rows. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopsight.llm import common as C

REROLE, DELETE, INSERT, CUT = 3, 4, 3, 3
_SPACES = " \t\n\x0b\x0c\r"
_NEVER = 1 << 60
# states: nothing yet, after s, after u, after a; the one role that may be written next, and where it leads
_NEXT = (2, 2, 3, 2)
_ENDS = (0, 3)
_ROLE = {2: "user", 3: "assistant"}
_GO = 8  # symbol of a row that must go; others are the initial's place in "sua", 3 for another, and 4 more if cut off


def _kept(symbol: int, state: int) -> int | None:
    """State after the row is kept as it is, None where that isn't allowed."""
    initial = symbol & 3
    if symbol == _GO or initial == 3:
        return None
    if initial == 0:
        return 1 if state == 0 else None
    return _NEXT[state] if _NEXT[state] == initial + 1 else None


def _times(a: list, b: list) -> list:
    return [[min(a[i][k] + b[k][j] for k in range(4)) for j in range(4)] for i in range(4)]


def _apply(a: list, v: list) -> list:
    return [min(a[i][k] + v[k] for k in range(4)) for i in range(4)]


def _inserted() -> list:
    """Cheapest insertions between states: no path needs more than two."""
    one = [[0 if i == j else _NEVER for j in range(4)] for i in range(4)]
    for i in range(4):
        one[i][_NEXT[i]] = INSERT
    return _times(one, one)


def _edited(symbol: int) -> list:
    """Cheapest edit of one row between states, insertions before it included."""
    cut = CUT if 4 <= symbol < _GO else 0
    row = [[DELETE if i == j else _NEVER for j in range(4)] for i in range(4)]
    for i in range(4):
        if symbol != _GO:
            row[i][_NEXT[i]] = min(row[i][_NEXT[i]], REROLE + cut)
        to = _kept(symbol, i)
        if to is not None:
            row[i][to] = min(row[i][to], cut)
    return _times(_inserted(), row)


_powers = {symbol: [_edited(symbol)] for symbol in range(9)}
_END = _apply(_inserted(), [0 if s in _ENDS else _NEVER for s in range(4)])


def _power(symbol: int, k: int) -> list:
    """The matrix of 2**k equal rows."""
    known = _powers[symbol]
    while len(known) <= k:
        known.append(_times(known[-1], known[-1]))
    return known[k]


def _cross(symbol: int, length: int, after: list) -> list:
    """Costs-to-go before a run, from those after it."""
    k = 0
    while length:
        if length & 1:
            after = _apply(_power(symbol, k), after)
        length >>= 1
        k += 1
    return after


def _one_row(symbol: int, state: int, after: list, out: bytearray) -> int:
    """Write the edits before and of one row, the least letter of the cheapest ones first."""
    cut = CUT if 4 <= symbol < _GO else 0
    before = _apply(_powers[symbol][0], after)
    while True:
        due, to = before[state], _kept(symbol, state)
        if DELETE + after[state] == due:
            out += b"D"
            return state
        if INSERT + before[_NEXT[state]] == due:
            out += b"I"
            state = _NEXT[state]
        elif to is not None and cut + after[to] == due:
            out += b"K"
            return to
        else:
            out += b"R"
            return _NEXT[state]


def _unroll(symbol: int, length: int, state: int, after: list, out: bytearray) -> int:
    """Write the edits of a run, halved until single rows are left."""
    if length == 1:
        return _one_row(symbol, state, after, out)
    k = (length - 1).bit_length() - 1
    state = _unroll(symbol, length - (1 << k), state, _apply(_power(symbol, k), after), out)
    return _unroll(symbol, 1 << k, state, after, out)


def cheapest_edits(symbols: np.ndarray) -> tuple[int, str]:
    """Least cost, and of the audits of that cost the one that is least in ASCII order."""
    begin = np.flatnonzero(np.r_[True, symbols[1:] != symbols[:-1]]) if len(symbols) else np.zeros(0, np.int64)
    kinds, lengths = symbols[begin], np.diff(np.r_[begin, len(symbols)])
    costs = np.empty((len(kinds) + 1, 4), np.int64)
    costs[-1] = after = _END
    for i in range(len(kinds) - 1, -1, -1):
        costs[i] = after = _cross(int(kinds[i]), int(lengths[i]), after)
    out, state = bytearray(), 0
    for i, (kind, length) in enumerate(zip(kinds.tolist(), lengths.tolist())):
        state = _unroll(kind, length, state, costs[i + 1].tolist(), out)
    while state not in _ENDS:
        out += b"I"
        state = _NEXT[state]
    return int(costs[0][0]), out.decode()


class _Repaired:
    """The hash of a repaired conversation, fed with its audit and then row by row."""

    def __init__(self, audit: str):
        self.edits, self.at, self.state, self.sum, self.first = audit, 0, 0, hashlib.sha256(), True

    def _write(self, role: str, text: str) -> None:
        self.sum.update(f"{'' if self.first else chr(10)}{role}:{text}".encode())
        self.first = False

    def _insertions(self) -> None:
        while self.at < len(self.edits) and self.edits[self.at] == "I":
            self.state = _NEXT[self.state]
            self._write(_ROLE[self.state], "")
            self.at += 1

    def row(self, role: str, text: str) -> None:
        self._insertions()
        edit = self.edits[self.at]
        self.at += 1
        if edit == "K":
            self.state = _kept("sua".index(role[0]), self.state)
            self._write(role, text)
        elif edit == "R":
            self.state = _NEXT[self.state]
            self._write(_ROLE[self.state], text)

    def digest(self) -> str:
        self._insertions()
        return self.sum.hexdigest()


_AUDIT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def _judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per conversation of rows (conv_id, turn, initial, fault) that come in order."""
    names = [f.split()[0] for f in _AUDIT.split(", ")]

    def finish(key, parts) -> list:
        turn, known, initial, fault = (np.concatenate([p[i] for p in parts]) for i in range(4))
        turn, known, initial, fault = (x[fault >= 0] for x in (turn, known, initial, fault))
        days = turn[known]
        gaps = int(days[-1] - days[0] + 1 - 1 - np.count_nonzero(days[1:] != days[:-1])) if len(days) else 0
        fits = np.isin(initial[:-1] * 4 + initial[1:], [0 * 4 + 1, 1 * 4 + 2, 2 * 4 + 1])
        symbols = np.where((fault == 1) | (fault == 2), _GO, initial + 4 * (fault == 3)).astype(np.int8)
        cost, audit = cheapest_edits(symbols)
        counts = [int((fault == f).sum()) for f in (1, 2, 3)]
        return [key, gaps, *counts, int((~fits).sum()), cost, audit]

    def table(rows: list) -> pa.RecordBatch:
        columns = list(zip(*rows))
        return pa.RecordBatch.from_pydict({n: pa.array(c, pa.string() if n == "audit" else pa.int64())
                                           for n, c in zip(names, columns)})

    held, parts, done = None, [], []
    for batch in batches:
        keys = batch["conv_id"]
        ids, none = np.asarray(keys.fill_null(0)), np.asarray(keys.is_null())
        turns = batch["turn"]
        columns = [np.asarray(turns.fill_null(0)), np.asarray(turns.is_valid()), np.asarray(batch["initial"]).astype(np.int8),
                   np.asarray(batch["fault"]).astype(np.int8)]
        edges = np.flatnonzero(np.r_[True, (ids[1:] != ids[:-1]) | (none[1:] != none[:-1]), True])
        for low, high in zip(edges[:-1], edges[1:]):
            key = None if none[low] else int(ids[low])
            if parts and key != held:
                done.append(finish(held, parts))
                parts = []
            held = key
            parts.append([c[low:high] for c in columns])
        if len(done) > 5000:
            yield table(done)
            done = []
    if parts:
        done.append(finish(held, parts))
    if done:
        yield table(done)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """conv_id and repaired_sha256: of each conversation the audit comes first, then its rows in order."""
    held, current, out = None, None, []

    def table():
        return pa.RecordBatch.from_pydict({"id": pa.array([r[0] for r in out], pa.int64()),
                                           "repaired_sha256": pa.array([r[1] for r in out], pa.string())})

    for batch in batches:
        for key, audit, role, text in zip(*(batch[c].to_pylist() for c in ("conv_id", "audit", "role", "text"))):
            if audit is not None:
                if current:
                    out.append((held, current.digest()))
                held, current = key, _Repaired(audit)
            else:
                current.row(role, text)
        if len(out) > 5000:
            yield table()
            out = []
    if current:
        out.append((held, current.digest()))
    if out:
        yield table()


def damaged(rows: DataFrame) -> DataFrame:
    """The rows conv_id, turn, role, text after the damage that the crc32 of conversation and turn names.

    Column ``lost`` marks a row that the damage drops; it stays as a mark of its conversation.
    """
    rows = C.query_columns(rows, conv_id="long", turn="long", role="string", text="string")
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    rows = rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"),
                       F.coalesce("text", F.lit(" ")).alias("text"), (F.crc32(key.cast("binary")) % 20).alias("kind"))
    copies = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select(
        "conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(
            F.col("text")).alias("text"),
        (F.col("kind") == 0).alias("lost"), copies.alias("copy")).drop("copy")


def repair(rows: DataFrame) -> DataFrame:
    """One row per conversation of ``rows`` (conv_id, turn, role, text, lost): faults, cost, audit, repaired_sha256."""
    rows = rows.withColumn("mark", F.md5(F.col("text").cast("binary")))
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "mark"]

    # the first turn of every role and text; within one turn the repeated rows are neighbours
    first = rows.where("not lost").groupBy("conv_id", "role", "mark").agg(
        F.min(F.struct(F.col("turn").isNotNull().alias("known"), "turn")).alias("first"),
        F.count("*").alias("n")).where("n > 1")
    end = F.rtrim(F.col("text"), F.lit(_SPACES))
    plain = rows.select(
        "conv_id", "turn", "role", "mark", "lost", (end == "").alias("blank"),
        F.substring(end, -1, 1).isin(".", "!", "?").alias("ended"),
        F.coalesce(F.nullif(F.instr(F.lit("sua"), F.substring("role", 1, 1)) * (F.length("role") > 0).cast("int"), F.lit(0)) - 1,
                   F.lit(3)).alias("initial"))
    seen = plain.alias("r").join(first.alias("f"), F.expr(
        "r.conv_id <=> f.conv_id AND r.role = f.role AND r.mark = f.mark"), "left").select(
        "r.*", F.coalesce(F.struct(F.col("r.turn").isNotNull().alias("known"), F.col("r.turn").alias("turn")) > F.col("f.first"),
                          F.lit(False)).alias("later"), F.col("f.n").isNotNull().alias("repeated"))

    def faults(batches):
        """Adds the fault; a row equal to the one before it in its turn is a duplicate too."""
        last = None
        for batch in batches:
            found = []
            columns = [batch[c].to_pylist() for c in ("conv_id", "turn", "role", "mark", "lost", "blank", "ended", "later", "repeated")]
            for conv, turn, role, mark, lost, blank, ended, later, repeated in zip(*columns):
                if lost:
                    found.append(-1)
                    continue
                here = (conv, turn, role, mark) if repeated else None
                again = later or (here is not None and here == last)
                last = here
                found.append(1 if blank else 2 if again else 0 if ended else 3)
            yield pa.RecordBatch.from_pydict({"conv_id": batch["conv_id"], "turn": batch["turn"], "initial": batch["initial"],
                                              "fault": pa.array(found, pa.int32())})

    def judged(batches):
        return _judged(faults(batches))

    audits = C.stage(seen.repartition("conv_id").sortWithinPartitions(*order).mapInArrow(judged, _AUDIT), "audits")
    texts = rows.where("not lost").select("conv_id", F.lit(None).cast("string").alias("audit"), "turn", "role", "mark", "text")
    heads = audits.select("conv_id", "audit", *[F.lit(None).cast(t).alias(c) for c, t in (
        ("turn", "long"), ("role", "string"), ("mark", "string"), ("text", "string"))])
    sums = heads.union(texts).repartition("conv_id").sortWithinPartitions(
        order[0], F.col("audit").asc_nulls_last(), *order[1:]).mapInArrow(_hashed, "id long, repaired_sha256 string")
    return audits.join(sums, F.col("conv_id").eqNullSafe(F.col("id"))).drop("id")


ORACLE = """
WITH RECURSIVE keyed AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
        list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(
            coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''),
            lambda ch: CAST(ascii(ch) AS BIGINT))),
            lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0],
                lambda d, z: xor(d >> 1, 3988292384 * (d & 1)))) AS crc
    FROM conversations
), kinds AS (
    SELECT conv_id, turn, role, text, xor(crc, 4294967295) % 20 AS kind FROM keyed
), rows_left AS (
    SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
        CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
        unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy
    FROM kinds WHERE kind <> 0
), placed AS (
    SELECT conv_id, turn, role, text, left(role, 1) AS i,
        rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), copy) AS pos,
        count(*) OVER (PARTITION BY conv_id) AS n,
        row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS seen
    FROM rows_left
), faulty AS (
    SELECT *, CASE WHEN body = '' THEN 'blank' WHEN seen > 1 THEN 'duplicate'
        WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
        lag(i) OVER (PARTITION BY conv_id ORDER BY pos) AS before
    FROM placed
), walk AS (
    SELECT DISTINCT conv_id, n + 1 AS pos,
        {'c': 0, 'a': '', 'r': CAST([] AS VARCHAR[])} AS g0,
        {'c': 6, 'a': 'II', 'r': ['user:', 'assistant:']} AS g1,
        {'c': 3, 'a': 'I', 'r': ['assistant:']} AS g2,
        {'c': 0, 'a': '', 'r': CAST([] AS VARCHAR[])} AS g3
    FROM faulty
    UNION ALL
    SELECT conv_id, pos,
        list_sort([h0, {'c': h2.c + 3, 'a': 'I' || h2.a, 'r': ['user:'] || h2.r},
            {'c': h3.c + 6, 'a': 'II' || h3.a, 'r': ['user:', 'assistant:'] || h3.r}])[1],
        list_sort([h1, {'c': h2.c + 3, 'a': 'I' || h2.a, 'r': ['user:'] || h2.r},
            {'c': h3.c + 6, 'a': 'II' || h3.a, 'r': ['user:', 'assistant:'] || h3.r}])[1],
        list_sort([h2, {'c': h3.c + 3, 'a': 'I' || h3.a, 'r': ['assistant:'] || h3.r}])[1],
        list_sort([h3, {'c': h2.c + 3, 'a': 'I' || h2.a, 'r': ['user:'] || h2.r}])[1]
    FROM (
        SELECT f.conv_id, f.pos,
            list_sort([{'c': w.g0.c + 4, 'a': 'D' || w.g0.a, 'r': w.g0.r}]
                || CASE WHEN stays AND i = 'u' THEN [{'c': w.g2.c + cut, 'a': 'K' || w.g2.a, 'r': [role || ':' || text] || w.g2.r}] ELSE [] END
                || CASE WHEN stays AND i = 's' THEN [{'c': w.g1.c + cut, 'a': 'K' || w.g1.a, 'r': [role || ':' || text] || w.g1.r}] ELSE [] END
                || CASE WHEN stays THEN [{'c': w.g2.c + 3 + cut, 'a': 'R' || w.g2.a, 'r': ['user:' || text] || w.g2.r}] ELSE [] END)[1] AS h0,
            list_sort([{'c': w.g1.c + 4, 'a': 'D' || w.g1.a, 'r': w.g1.r}]
                || CASE WHEN stays AND i = 'u' THEN [{'c': w.g2.c + cut, 'a': 'K' || w.g2.a, 'r': [role || ':' || text] || w.g2.r}] ELSE [] END
                || CASE WHEN stays THEN [{'c': w.g2.c + 3 + cut, 'a': 'R' || w.g2.a, 'r': ['user:' || text] || w.g2.r}] ELSE [] END)[1] AS h1,
            list_sort([{'c': w.g2.c + 4, 'a': 'D' || w.g2.a, 'r': w.g2.r}]
                || CASE WHEN stays AND i = 'a' THEN [{'c': w.g3.c + cut, 'a': 'K' || w.g3.a, 'r': [role || ':' || text] || w.g3.r}] ELSE [] END
                || CASE WHEN stays THEN [{'c': w.g3.c + 3 + cut, 'a': 'R' || w.g3.a, 'r': ['assistant:' || text] || w.g3.r}] ELSE [] END)[1] AS h2,
            list_sort([{'c': w.g3.c + 4, 'a': 'D' || w.g3.a, 'r': w.g3.r}]
                || CASE WHEN stays AND i = 'u' THEN [{'c': w.g2.c + cut, 'a': 'K' || w.g2.a, 'r': [role || ':' || text] || w.g2.r}] ELSE [] END
                || CASE WHEN stays THEN [{'c': w.g2.c + 3 + cut, 'a': 'R' || w.g2.a, 'r': ['user:' || text] || w.g2.r}] ELSE [] END)[1] AS h3
        FROM walk w JOIN (SELECT *, fault NOT IN ('blank', 'duplicate') AS stays,
            CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END AS cut FROM faulty) f
            ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.pos = w.pos - 1
    )
), counted AS (
    SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
        count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
        count(*) FILTER (fault = 'truncated') AS truncated,
        count(*) FILTER (before IS NOT NULL AND before || i NOT IN ('su', 'ua', 'au')) AS illegal
    FROM faulty GROUP BY conv_id
)
SELECT k.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank,
    CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated,
    CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(w.g0.c, 0) AS BIGINT) AS cost,
    coalesce(w.g0.a, '') AS audit, sha256(coalesce(array_to_string(w.g0.r, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) k
LEFT JOIN counted c ON k.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN (SELECT * FROM walk WHERE pos = 1) w ON k.conv_id IS NOT DISTINCT FROM w.conv_id
"""
