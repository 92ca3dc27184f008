"""Cheapest repair of conversations by an automaton of turn signatures, shared from their ends.

1. Every turn becomes one letter: the class of its role (s, u, a, or o for others) and its first
   fault (blank, duplicate, truncated). Only ids, roles and digests of texts move for this; copies
   of a turn merge inside the tasks. Turns are dealt by ranges of (conversation, turn), so the turns
   of one long conversation lie in many tasks, which hand on strings of letters.
2. Different signatures are sorted from their last letter on. Signatures that end alike are then
   neighbours, and a task walks them as paths of one automaton minimised from the end: a node is a
   suffix and stays while the next path shares it. For each node and grammar state the cost-to-go
   and the first edit of the best suffix are found once; nodes whose costs-to-go differ by a
   constant share one remembered step. (The first node of a range may be met by two tasks.)
3. The edits of a conversation stand before its turns in one sorted stream, which applies them.

An edit's choices differ in their letter (D, I, K or R), so of equally cheap audits the first
letter alone tells the least.

A conversation's letters and audit lie in one row, and a digest of its repaired text reads
its turns one after the other in one task, as such results must. No task holds their texts.

Defined cases: a null role or text is one space; a null conv_id is a conversation of its own; turns
sort by number (null first), then role, then the MD5 digest of the text, so copies are neighbours;
role is its first character, other than s, u, a (empty, too) fits no grammar state; texts may
have any length; conversations without turns have no faults, cost 0 and an empty audit; no rows
give no rows; extra columns play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayloom.llm.common import SPACES
from assayloom.operators.lookup import spread_join
from assayloom.session import stored

DELETE, INSERT, REROLE, TRUNCATED = 4, 3, 3, 3
ROLES = "suao"
#: One letter per role class and fault; blank and duplicate turns must go, so they share one letter.
SOUND, CUT_OFF, BLANK, DUPLICATE = "suao", "SUAO", "0123", "4567"
MUST_GO = "x"

# Grammar states: start, after system, after user, after assistant; start and the last may end.
START, SYSTEM, USER, ASSISTANT = range(4)
#: The state an inserted or re-roled turn leads to: an assistant after a user, else a user.
_TURNED = (USER, USER, ASSISTANT, USER)
#: The state a kept turn of a role leads to, if the grammar lets it follow.
_KEPT = {("s", START): SYSTEM, ("u", START): USER, ("u", SYSTEM): USER, ("u", ASSISTANT): USER,
         ("a", USER): ASSISTANT}
#: After the last turn: cost-to-go and first edit of each state.
_END = ((0, INSERT * 2, INSERT, 0), ("", "I", "I", ""))


@lru_cache(maxsize=1 << 16)
def _step(letter: str, after: tuple[int, ...]) -> tuple[int, tuple[int, ...], tuple[str, ...]]:
    """From the costs-to-go behind a turn (least 0) to those before it: what all have in common,
    the rest, and the first edit of each state."""
    penalty = TRUNCATED if letter in CUT_OFF else 0
    best = []
    for state in range(4):
        choices = [(DELETE + after[state], "D")]
        if letter != MUST_GO:
            choices.append((REROLE + penalty + after[_TURNED[state]], "R"))
            kept = _KEPT.get((letter.lower(), state))
            if kept is not None:
                choices.append((penalty + after[kept], "K"))
        best.append(min(choices))
    # Two inserts in a row are the most that can pay: each leads to the other's state.
    for _ in range(2):
        best = [min(own, (INSERT + best[_TURNED[state]][0], "I")) for state, own in enumerate(best)]
    least = min(cost for cost, _ in best)
    return least, tuple(cost - least for cost, _ in best), tuple(edit for _, edit in best)


class SuffixAutomaton:
    """The path of the last signature, from its end; nodes shared with the next one stay."""

    def __init__(self):
        self._letters: list[str] = []
        self._nodes = [(0, *_END)]  # (cost in common, costs beyond it, first edits)

    def solve(self, signature: str) -> tuple[int, str]:
        """Cost and audit of the cheapest repair."""
        turned, shared = signature[::-1], 0
        for a, b in zip(turned, self._letters):
            if a != b:
                break
            shared += 1
        del self._letters[shared:], self._nodes[shared + 1:]
        for letter in turned[shared:]:
            common, after, _ = self._nodes[-1]
            added, costs, edits = _step(letter, after)
            self._nodes.append((common + added, costs, edits))
            self._letters.append(letter)
        common, costs, _ = self._nodes[-1]
        return common + costs[START], "".join(self._walk())

    def _walk(self) -> Iterator[str]:
        state, at = START, len(self._letters)
        while edit := self._nodes[at][2][state]:
            yield edit
            if edit in "IR":
                state = _TURNED[state]
            elif edit == "K":
                state = _KEPT[self._letters[at - 1].lower(), state]
            at -= edit != "I"


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    automaton = SuffixAutomaton()
    for batch in batches:
        found = [automaton.solve(s) for s in batch.column("signature").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("signature"), pa.array([c for c, _ in found], pa.int64()),
             pa.array([a for _, a in found], pa.string())],
            ["signature", "cost", "audit"],
        )


_PIECE = pa.schema([
    ("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("digest", pa.string()),
    ("letters", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("turns", pa.int64()),
])


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Letters of a conversation's neighbouring turns, joined: one row per conversation and task.

    It starts with the place of its first turn; first, last and turns are of the turn numbers.
    """
    done: list[tuple] = []
    head, letters, first, last, turns = None, [], None, None, 0

    def close() -> None:
        if head is not None:
            done.append((*head, "".join(letters), first, last, turns))

    def written() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_pylist([dict(zip(_PIECE.names, d)) for d in done], _PIECE)
        done.clear()
        return batch

    for batch in batches:
        names = ("conv_id", "turn", "role", "digest", "letters")
        for conv, turn, role, digest, some in zip(*(batch.column(n).to_pylist() for n in names)):
            if head is None or conv != head[0]:
                close()
                head, letters, first, last, turns = (conv, turn, role, digest), [], None, None, 0
            letters.append(some)
            if turn is not None and some and turn != last:
                first, last, turns = turn if first is None else first, turn, turns + 1
        if done:
            yield written()
    close()
    if done:
        yield written()


def _turns(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and the digest that orders turns of one number and role."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(" "))
    return rows.select(
        F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"),
        F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"), text.alias("text"),
        F.md5(text).alias("digest"),
    )


def _letter(alphabet: str) -> Column:
    """The letter of the row's role class in ``alphabet``."""
    first = F.substring("role", 1, 1)
    out = F.lit(alphabet[3])
    for role, letter in zip(ROLES[:3], alphabet):
        out = F.when(first == role, F.lit(letter)).otherwise(out)
    return out


def signatures(rows: DataFrame, conversations: DataFrame) -> DataFrame:
    """conv_id, letters (of all turns in order) and gaps, for every conv_id of ``conversations``."""
    stripped = F.rtrim("text", F.lit(SPACES.decode()))
    narrow = _turns(rows).select(
        "conv_id", "turn", "role", "digest", (stripped == "").alias("blank"),
        (~F.right(stripped, F.lit(1)).isin(".", "!", "?")).alias("cut_off"), F.lit(1).alias("n"),
    )
    keys = ["conv_id", "turn", "role", "digest", "blank", "cut_off"]
    nothing = conversations.select(F.col("conv_id").cast("bigint")).distinct().select(
        "conv_id", *[F.lit(None).cast(narrow.schema[k].dataType).alias(k) for k in keys[1:]],
        F.lit(0).alias("n"),
    )
    merged = narrow.unionByName(nothing).groupBy(*keys).agg(F.sum("n").alias("n"))
    order = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    earliest = merged.groupBy("conv_id", "role", "digest").agg(F.min(order).alias("earliest"))
    m, e = merged.alias("m"), earliest.alias("e")
    same = [F.col(f"m.{k}").eqNullSafe(F.col(f"e.{k}")) for k in ("conv_id", "role", "digest")]
    copies = F.col("n").cast("int")
    letters = (
        F.when(copies == 0, F.lit(""))
        .when(F.col("blank"), F.repeat(_letter(BLANK), copies))
        .when(order == F.col("earliest"), F.concat(
            F.when(F.col("cut_off"), _letter(CUT_OFF)).otherwise(_letter(SOUND)),
            F.repeat(_letter(DUPLICATE), copies - 1)))
        .otherwise(F.repeat(_letter(DUPLICATE), copies))
    )
    lettered = m.join(e, same[0] & same[1] & same[2]).select(
        "m.conv_id", "m.turn", "m.role", "m.digest", "n", "earliest", "blank", "cut_off",
    ).select("conv_id", "turn", "role", "digest", letters.alias("letters"))
    along = [F.asc_nulls_first(c) for c in ("conv_id", "turn", "role", "digest")]
    pieces = lettered.repartitionByRange(*along).sortWithinPartitions(*along).mapInArrow(
        _pieces, "conv_id bigint, turn bigint, role string, digest string, letters string, "
                 "first bigint, last bigint, turns bigint")
    # As many pieces as the tasks that a conversation spans.
    joined = pieces.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct(
        F.col("turn").isNotNull().alias("known"), *_PIECE.names[1:]))).alias("p"))
    numbered = F.filter("p", lambda x: x["first"].isNotNull())
    most = F.greatest(F.size("q") - 1, F.lit(0))
    met = F.zip_with(F.slice("q", F.lit(2), most), F.slice("q", F.lit(1), most),
                     lambda b, a: (b["first"] == a["last"]).cast("bigint"))
    zero = F.lit(0).cast("bigint")
    distinct = (F.aggregate("q", zero, lambda n, x: n + x["turns"])
                - F.aggregate(met, zero, lambda n, x: n + x))
    span = F.array_max(F.transform("q", lambda x: x["last"])) - F.array_min(
        F.transform("q", lambda x: x["first"])) + 1
    return joined.withColumn("q", numbered).select(
        "conv_id", F.array_join(F.transform("p", lambda x: x["letters"]), "").alias("letters"),
        F.coalesce(span - distinct, zero).alias("gaps"),
    )


def _count_of(alphabet: str) -> Column:
    return F.length("letters") - F.length(F.translate("letters", alphabet, ""))


def conversation_reports(rows: DataFrame, conversations: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit for every conv_id of
    ``conversations``; ``rows`` holds the turns they have (conv_id, turn, role, text)."""
    of_all = stored(signatures(rows, conversations), "signatures")
    must_go = F.translate("letters", BLANK + DUPLICATE, MUST_GO * 8).alias("signature")
    turned = F.reverse("signature")
    solved = stored(
        of_all.select(must_go).distinct().repartitionByRange(turned).sortWithinPartitions(turned)
        .mapInArrow(_solve, "signature string, cost bigint, audit string"), "audits")
    roles = F.translate("letters", CUT_OFF + BLANK + DUPLICATE, ROLES * 3)
    legal = F.regexp_count(roles, F.lit("(?=su|ua|au)"))
    # Many conversations share a signature: those of a hot one are split over tasks.
    return spread_join(of_all.select("*", must_go), solved, "signature", "left", ["conv_id"]).select(
        "conv_id", "gaps",
        *[_count_of(a).cast("bigint").alias(n) for n, a in
          (("blank", BLANK), ("duplicate", DUPLICATE), ("truncated", CUT_OFF))],
        (F.greatest(F.length("letters") - 1, F.lit(0)) - legal).cast("bigint").alias("illegal"),
        "cost", "audit",
    )


# --- repaired turns ----------------------------------------------------------------------------

_REPORT = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, " \
    "cost bigint, audit string"
_REPORT_NAMES = [field.split()[0] for field in _REPORT.split(", ")]


class _Edits:
    """Applies one conversation's audit to its turns, in order."""

    def __init__(self, audit: str):
        self._audit, self._at, self._state = audit, 0, START

    def _turned(self) -> str:
        self._state = _TURNED[self._state]
        return "user" if self._state == USER else "assistant"

    def inserted(self) -> Iterator[tuple[str, str, str]]:
        while self._audit[self._at:self._at + 1] == "I":
            self._at += 1
            yield "I", self._turned(), ""

    def turn(self, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        yield from self.inserted()
        edit = self._audit[self._at]
        self._at += 1
        if edit == "K":
            self._state = _KEPT[role[:1], self._state]
            yield edit, role, text
        elif edit == "R":
            yield edit, self._turned(), text


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """("report", conv_id, its figures) once for every conversation, then ("turn", conv_id,
    (edit, role, text)) for each repaired turn, from sorted batches."""
    edits, own = None, None
    for batch in batches:
        figures = zip(*(batch.column(n).to_pylist() for n in _REPORT_NAMES))
        turns = zip(*(batch.column(n).to_pylist() for n in ("conv_id", "kind", "role", "text")))
        for (conv, kind, role, text), report in zip(turns, figures):
            if kind == 1:
                yield from (("turn", conv, t) for t in edits.turn(role, text))
                continue
            if edits is not None:
                yield from (("turn", own, t) for t in edits.inserted())
            edits, own = _Edits(report[-1]), conv
            yield "report", conv, report
    if edits is not None:
        yield from (("turn", own, t) for t in edits.inserted())


def _stream(rows: DataFrame, reports: DataFrame) -> DataFrame:
    """Each conversation's report, then its turns in order, side by side in one task."""
    turns = _turns(rows).withColumn("kind", F.lit(1))
    both = turns.unionByName(reports.withColumn("kind", F.lit(0)), allowMissingColumns=True)
    order = [F.asc_nulls_first(c) for c in ("conv_id", "kind", "turn", "role", "digest")]
    return both.repartition("conv_id").sortWithinPartitions(*order)


def _full(rows: list, schema: pa.Schema) -> pa.RecordBatch:
    batch = pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema.names)
    rows.clear()
    return batch


def _as_turns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("conv_id", pa.int64()), ("place", pa.int64()), ("edit", pa.string()),
                        ("role", pa.string()), ("text", pa.string())])
    out, place, size = [], 0, 0
    for kind, conv, found in _edited(batches):
        if kind == "report":
            place = 0
            continue
        out.append((conv, place, *found))
        place, size = place + 1, size + len(found[2])
        if len(out) == 1000 or size > 1 << 24:
            size = 0
            yield _full(out, schema)
    if out:
        yield _full(out, schema)


def repaired_turns(rows: DataFrame, reports: DataFrame) -> DataFrame:
    """conv_id, place (from 0), edit (K, R or I), role, text of the turns after the repair."""
    return _stream(rows, reports).mapInArrow(
        _as_turns, "conv_id bigint, place bigint, edit string, role string, text string")


def _as_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("conv_id", pa.int64()), *[(n, pa.int64()) for n in _REPORT_NAMES[:-1]],
                        ("audit", pa.string()), ("repaired_sha256", pa.string())])
    out, own, digest, link = [], None, None, ""
    for kind, conv, found in _edited(batches):
        if kind == "report":
            if own is not None:
                out.append((*own, digest.hexdigest()))
            own, digest, link = (conv, *found), hashlib.sha256(), ""
            if len(out) == 1000:
                yield _full(out, schema)
        else:
            digest.update(f"{link}{found[1]}:{found[2]}".encode())
            link = "\n"
    if own is not None:
        out.append((*own, digest.hexdigest()))
    if out:
        yield _full(out, schema)


def repair_digests(rows: DataFrame, conversations: DataFrame) -> DataFrame:
    """The report of every conversation and the SHA-256 of its repaired ``role:text`` lines."""
    reports = stored(conversation_reports(rows, conversations), "reports")
    return _stream(rows, reports).mapInArrow(
        _as_digests, f"conv_id bigint, {_REPORT}, repaired_sha256 string")


# --- the registered query ----------------------------------------------------------------------


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text after damage by the CRC-32 of ``conv_id:turn`` (null: a space)."""
    conv, turn = F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint")
    key = F.concat(F.coalesce(conv.cast("string"), F.lit(" ")), F.lit(":"),
                   F.coalesce(turn.cast("string"), F.lit(" ")))
    kind = (F.crc32(key.cast("binary")) % 20).alias("kind")
    rows = conversations.select(
        conv.alias("conv_id"), turn.alias("turn"),
        *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")], kind)
    text = F.when(F.col("kind") == 1, "").when(
        F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return rows.where("kind <> 0").select(
        "conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        text.alias("text"), F.explode(copies).alias("_copy"),
    ).drop("_copy")

ORACLE_SQL = r"""WITH RECURSIVE damage AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(
           string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''),
           lambda c: ascii(c)::BIGINT)),
           lambda c, b: list_reduce(list_prepend(xor(c, b), repeat([0::BIGINT], 8)),
             lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END))) % 20
         AS kind
  FROM conversations),
rows AS (
  SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM damage, range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text)) AS pos,
         regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS ending,
         CASE left(role, 1) WHEN 's' THEN 's' WHEN 'u' THEN 'u' WHEN 'a' THEN 'a' ELSE 'o' END AS r
  FROM rows),
faults AS (
  SELECT *, CASE WHEN ending = '' THEN 'b'
                 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 THEN 'd'
                 WHEN ending NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault,
         lag(r) OVER (PARTITION BY conv_id ORDER BY pos) AS earlier
  FROM placed),
ends AS (
  SELECT conv_id, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) AS n,
         count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
         count(*) FILTER (fault = 't') AS truncated,
         count(*) FILTER (earlier IS NOT NULL AND earlier || r NOT IN ('su', 'ua', 'au')) AS illegal
  FROM faults GROUP BY conv_id),
-- From the last turn on: best (cost, audit, lines) pos the start, after s, after u, after a.
best AS (
  SELECT conv_id, n AS pos, {'c': 0, 'a': '', 't': []::VARCHAR[]} AS zero,
         {'c': 6, 'a': 'II', 't': ['user:', 'assistant:']} AS s,
         {'c': 3, 'a': 'I', 't': ['assistant:']} AS u, {'c': 0, 'a': '', 't': []::VARCHAR[]} AS a
  FROM ends
  UNION ALL
  SELECT conv_id, pos, least(zero, {'c': 3 + u.c, 'a': 'I' || u.a, 't': list_prepend('user:', u.t)}),
         least(s, {'c': 3 + u.c, 'a': 'I' || u.a, 't': list_prepend('user:', u.t)}), u, a
  FROM (
    SELECT conv_id, pos, zero, s,
           least(u, {'c': 3 + a.c, 'a': 'I' || a.a, 't': list_prepend('assistant:', a.t)}) AS u,
           least(a, {'c': 3 + u.c, 'a': 'I' || u.a, 't': list_prepend('user:', u.t)}) AS a
    FROM (
      SELECT conv_id, b.pos - 1 AS pos,
        least({'c': 4 + zero.c, 'a': 'D' || zero.a, 't': zero.t},
          CASE WHEN ok THEN {'c': 3 + p + u.c, 'a': 'R' || u.a, 't': list_prepend('user:' || text, u.t)} END,
          CASE WHEN ok AND r = 's' THEN {'c': p + s.c, 'a': 'K' || s.a, 't': list_prepend(line, s.t)} END,
          CASE WHEN ok AND r = 'u' THEN {'c': p + u.c, 'a': 'K' || u.a, 't': list_prepend(line, u.t)} END) AS zero,
        least({'c': 4 + s.c, 'a': 'D' || s.a, 't': s.t},
          CASE WHEN ok THEN {'c': 3 + p + u.c, 'a': 'R' || u.a, 't': list_prepend('user:' || text, u.t)} END,
          CASE WHEN ok AND r = 'u' THEN {'c': p + u.c, 'a': 'K' || u.a, 't': list_prepend(line, u.t)} END) AS s,
        least({'c': 4 + u.c, 'a': 'D' || u.a, 't': u.t},
          CASE WHEN ok THEN {'c': 3 + p + a.c, 'a': 'R' || a.a, 't': list_prepend('assistant:' || text, a.t)} END,
          CASE WHEN ok AND r = 'a' THEN {'c': p + a.c, 'a': 'K' || a.a, 't': list_prepend(line, a.t)} END) AS u,
        least({'c': 4 + a.c, 'a': 'D' || a.a, 't': a.t},
          CASE WHEN ok THEN {'c': 3 + p + u.c, 'a': 'R' || u.a, 't': list_prepend('user:' || text, u.t)} END,
          CASE WHEN ok AND r = 'u' THEN {'c': p + u.c, 'a': 'K' || u.a, 't': list_prepend(line, u.t)} END) AS a
      FROM best b JOIN (
        SELECT conv_id AS id, pos AS place, r, text, role || ':' || text AS line,
               fault NOT IN ('b', 'd') AS ok, CASE fault WHEN 't' THEN 3 ELSE 0 END AS p
        FROM faults) f ON b.conv_id IS NOT DISTINCT FROM f.id AND b.pos = f.place))),
done AS (SELECT * FROM best WHERE pos = 0)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank,
       coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
       coalesce(illegal, 0)::BIGINT AS illegal, coalesce(zero.c, 0)::BIGINT AS cost,
       coalesce(zero.a, '') AS audit,
       sha256(coalesce(array_to_string(zero.t, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c
LEFT JOIN ends e ON c.conv_id IS NOT DISTINCT FROM e.conv_id
LEFT JOIN done d ON c.conv_id IS NOT DISTINCT FROM d.conv_id"""
