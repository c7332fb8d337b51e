"""Conversation structure repair: damage, faults, and the cheapest edits that restore the turn order.

A repaired conversation's role initials read ``(s?(ua)+)?``. The edits are found by dynamic programming over
retained subsequences: a state is a turn that is kept or reroled and the initial it then has. Backwards over
the turns, a state's cost is the least over the next retained turn of the deletions between (a difference
of prefix sums), the inserts that the pair of initials asks for, and that turn's own cost to the end; a
running minimum for each initial, taken with the prefix sum, makes each step constant. The audit then
walks forwards and takes, among edits of the least cost, the one whose initial is least (Delete, Insert, Keep,
Rerole), which gives the least audit, for an initial names one edit in each state.

For this a conversation's turns are one letter each. Texts are never gathered: the repaired text is
hashed as the sorted turns stream by behind their conversation's audit."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, arrow_limits, partitions, stored

NOT_SPACE = r"[^\x20\x09-\x0D]"
DELETE, REROLE, INSERT, TRUNCATED = 3, 2, 2, 1
ROLES = {"s": "system", "u": "user", "a": "assistant"}
#: Initials to insert between a state and the initial of the next retained turn; "" is the start, "$" the end.
GAPS = {
    ("", "s"): "", ("", "u"): "", ("", "a"): "u", ("", "$"): "",
    ("s", "u"): "", ("s", "a"): "u", ("s", "$"): "ua",
    ("u", "u"): "a", ("u", "a"): "", ("u", "$"): "a",
    ("a", "u"): "", ("a", "a"): "u", ("a", "$"): "",
}
STATES = ["", "s", "u", "a"]
FAR = 1 << 60


def damaged(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, alive after the damage; a dropped row stays, not alive, for its conversation."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    hit = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    text = F.when(hit == 1, "").when(hit == 2, F.regexp_replace(space("text"), "[.!?]", "")).otherwise(space("text"))
    role = F.when(hit == 4, "user").otherwise(space("role"))
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), (hit != 0).alias("alive"), F.when(hit == 3, 2).otherwise(1).alias("copies"))
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).drop("copies", "copy")


def faulted(rows: DataFrame) -> DataFrame:
    """The rows with key, place (from 0, by turn, nulls first; ties by role and text), fault, whether the step from the turn before is illegal, and whether the turn number is new.

    rows: conv_id, turn, role, text, alive; key names a conversation, null included."""
    keyed = rows.withColumn("key", F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")))
    ordered = Window.partitionBy("key").orderBy(F.desc("alive"), F.asc_nulls_first("turn"), "role", "text", "again")
    same = Window.partitionBy("key", "role", "text").orderBy(F.desc("alive"), F.asc_nulls_first("turn"))
    initial = F.substring("role", 1, 1)
    step = F.concat(F.lag(initial).over(ordered), initial)
    blank = ~F.col("text").rlike(NOT_SPACE)
    cut = ~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    rows = keyed.withColumn("again", F.row_number().over(same) > 1).withColumn("place", F.row_number().over(ordered) - 1).withColumn("step", step).withColumn("before", F.lag("turn").over(ordered))
    fault = F.when(blank, "blank").when(F.col("again"), "duplicate").when(cut, "truncated").otherwise("none")
    illegal = F.coalesce(~F.col("step").isin("su", "ua", "au"), F.lit(False))
    return rows.withColumn("fault", fault).withColumn("illegal", illegal).withColumn("new", F.col("turn").isNotNull() & ~F.col("turn").eqNullSafe(F.col("before"))).drop("again", "step", "before")


#: A turn's letter: its initial if that is one of the three, else x; upper case where truncated; - where it can't stay.
def _letter() -> Column:
    initial = F.substring("role", 1, 1)
    known = F.when(initial.isin("s", "u", "a"), initial).otherwise("x")
    return F.when(F.col("fault").isin("blank", "duplicate"), "-").when(F.col("fault") == "truncated", F.upper(known)).otherwise(known)


def repair(turns: str) -> tuple[int, str]:
    """Least cost and audit of a conversation, given a letter for each turn."""
    n = len(turns)
    # ways of retaining a turn: the initial it then has and what that costs
    ways = {"-": (), "s": (("s", 0), ("u", REROLE), ("a", REROLE)), "u": (("u", 0), ("a", REROLE)), "a": (("a", 0), ("u", REROLE)), "x": (("u", REROLE), ("a", REROLE))}
    ways |= {k.upper(): tuple((q, c + TRUNCATED) for q, c in v) for k, v in ways.items() if k != "-"}
    price = {pair: INSERT * len(gap) for pair, gap in GAPS.items()}
    # deleted[i]: deletions of turns 0 to i - 1. least[q][i]: over retained turns j >= i of initial q, deleted[j] + cost of j to the end
    deleted = [DELETE * i for i in range(n + 1)]
    least = {q: [FAR] * (n + 1) for q in "sua"}
    least["$"] = [deleted[n]] * (n + 1)

    def rest(state: str, i: int) -> int:
        """Least cost from turn i on, after a retained turn (or start) of this state."""
        return min(least[q][i] + cost for (p, q), cost in price.items() if p == state) - deleted[i]

    after = {"s": 0, "u": 0, "a": 0}
    for i in range(n - 1, -1, -1):
        after = {q: rest(q, i + 1) for q in "sua"}
        for q in "sua":
            least[q][i] = least[q][i + 1]
        for q, cost in ways[turns[i]]:
            least[q][i] = min(least[q][i], deleted[i] + cost + after[q])
    total = rest("", 0)

    audit, state = [], ""
    for i in range(n):
        if DELETE + rest(state, i + 1) == rest(state, i):
            audit.append("D")
            continue
        # this turn is retained next: the fewest letters before I or K, then Keep before Rerole
        goal = rest(state, i)
        options = []
        for q, cost in ways[turns[i]]:
            gap = GAPS.get((state, q))
            if gap is not None and INSERT * len(gap) + cost + rest(q, i + 1) == goal:
                kept = turns[i].lower() == q
                options.append(("I" * len(gap) + ("K" if kept else "R"), q))
        edit, state = min(options)
        audit.append(edit)
    audit.append("I" * len(GAPS[state, "$"]))
    return total, "".join(audit)


def _audited(conversations: DataFrame) -> DataFrame:
    """The rows (key, ..., letters) with cost and audit in place of letters."""
    names = [c for c in conversations.columns if c != "letters"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [repair(x) for x in batch.column("letters").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array([c for c, _ in found], pa.int64()), pa.array([a for _, a in found], pa.string())], [*names, "cost", "audit"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in conversations.select(*names).schema)
    return conversations.mapInArrow(run, f"{kinds}, cost long, audit string")


class Repaired:
    """The repaired conversation's lines ``role:text``, handed on as its turns come in."""

    def __init__(self, audit: str):
        self.audit, self.at, self.last = audit, 0, ""
        self.digest = hashlib.sha256()

    def _next(self) -> str:
        """The initial that an inserted or reroled turn has here."""
        return "a" if self.last == "u" else "u"

    def _say(self, role: str, initial: str, text: str) -> None:
        self.digest.update(((("\n" if self.last else "") + role + ":" + text)).encode())
        self.last = initial

    def _inserts(self) -> None:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self._say(ROLES[self._next()], self._next(), "")
            self.at += 1

    def turn(self, role: str, text: str) -> None:
        self._inserts()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            self._say(role, role[0], text)
        elif edit == "R":
            self._say(ROLES[self._next()], self._next(), text)

    def end(self) -> str:
        self._inserts()
        return self.digest.hexdigest()


def _hashed(stream: DataFrame, named: str) -> DataFrame:
    """key and the hash of each conversation; stream: key, place, role, text sorted by key and place, the audit as text of place -1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, open_ = None, None
        for batch in batches:
            keys, hashes = [], []
            for k, place, role, text in zip(*(batch.column(c).to_pylist() for c in ("key", "place", "role", "text")), strict=True):
                if place < 0:
                    if open_:
                        keys.append(key)
                        hashes.append(open_.end())
                    key, open_ = k, Repaired(text)
                else:
                    open_.turn(role, text)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(hashes, pa.string())], ["key", named])
        if open_:
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.string()), pa.array([open_.end()], pa.string())], ["key", named])

    return stream.mapInArrow(run, f"key string, {named} string")


def repair_conversations(turns: DataFrame, damage: bool = True) -> DataFrame:
    """Faults, least-cost edits and repaired text of each conversation.

    turns: conv_id, turn, role, text; other columns are left out. A null counts as one space in role, text
    and the key of the damage; rows with a null conv_id are one conversation. ``damage`` False
    repairs the rows as they are. Turns come by turn number, nulls first, equal ones by role, then
    text. A turn's first fault counts: blank, duplicate (role and text seen earlier), truncated (does not end in
    ``[.!?]``). Keep costs 0, Rerole to user or assistant 2, Delete 3 (blank and duplicate turns must go), Insert of an
    empty user or assistant turn 2; a truncated turn that stays adds 1.

    Returns per conversation, those with all rows dropped included: conv_id, gaps (turn numbers missing between the
    least and the greatest), blank, duplicate, truncated, illegal (neighbours whose initials are not su, ua or au), cost, audit
    (initials of the cheapest edits, the ASCII-least of several) and repaired_sha256 (of the lines role:text). An empty
    table gives an empty result. One task holds a letter for each turn of a conversation, as the audit does, but no texts; a
    conversation's hash is one chain, so its texts pass through one task in order."""
    spark = turns.sparkSession
    arrow_limits(spark)
    scratch = Scratch()
    rows = damaged(turns) if damage else turns.select("conv_id", F.col("turn").cast("long").alias("turn"), *(F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")), F.lit(True).alias("alive"))
    rows = scratch.stored(faulted(rows), "turns")
    alive = F.col("alive")
    count = lambda test: F.count(F.when(alive & test, 1))
    turn = F.when(alive, F.col("turn"))
    found = rows.groupBy("key").agg(
        F.first("conv_id").alias("conv_id"),
        F.coalesce(F.max(turn) - F.min(turn) + 1 - count(F.col("new")), F.lit(0)).cast("long").alias("gaps"),
        *(count(F.col("fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")),
        count(F.col("illegal")).alias("illegal"),
        F.array_sort(F.collect_list(F.when(alive, F.struct("place", _letter().alias("letter"))))).alias("letters"),
    )
    found = scratch.stored(_audited(found.withColumn("letters", F.array_join(F.transform("letters", lambda x: x.letter), ""))), "audits")
    audits = found.select("key", F.lit(-1).alias("place"), F.lit("").alias("role"), F.col("audit").alias("text"))
    stream = rows.where("alive").select("key", F.col("place").cast("int").alias("place"), "role", "text").union(audits)
    stream = stream.repartition(partitions(spark), "key").sortWithinPartitions("key", "place")
    result = stored(found.join(_hashed(stream, "repaired_sha256"), "key").drop("key"), "repaired")
    scratch.drop()
    return result


#: CRC-32 of a short ASCII string, bit by bit.
_CRC = """xor(4294967295, list_reduce(list_transform(string_split(k, ''), lambda c: ascii(c)::BIGINT), lambda r, b: list_reduce([0, 0, 0, 0, 0, 0, 0, 0], lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, xor(r, b)), 4294967295::BIGINT))"""


def _candidate(source: str, target: str, edit: str, base: str, role: str) -> str:
    """A struct (cost, audit, out) in SQL: from ``source`` the gap's inserts, then this turn as ``role`` in state ``target``."""
    gap = GAPS[source, target]
    inserted = "".join(f" || chr(10) || '{ROLES[g]}:'" for g in gap)
    said = f"x.{STATE_NAMES[source]}.o{inserted} || chr(10) || {role} || ':' || text"
    return f"{{'c': x.{STATE_NAMES[source]}.c + {INSERT * len(gap)} + {base} + late, 'a': x.{STATE_NAMES[source]}.a || '{'I' * len(gap)}{edit}', 'o': {said}}}"


STATE_NAMES = {"": "z", "s": "s", "u": "u", "a": "a"}


def _step(target: str) -> str:
    """The best way in SQL to be in ``target`` after one more turn."""
    name = STATE_NAMES[target]
    ways = [f"{{'c': x.{name}.c + {DELETE}, 'a': x.{name}.a || 'D', 'o': x.{name}.o}}"]
    for source in STATES:
        if (source, target) in GAPS and target:
            ways.append(f"CASE WHEN stays AND ini = '{target}' THEN {_candidate(source, target, 'K', '0', 'role')} END")
            if target != "s":
                ways.append(f"CASE WHEN stays AND ini <> '{target}' THEN {_candidate(source, target, 'R', str(REROLE), f"'{ROLES[target]}'")} END")
    return f"'{name}': list_sort(list_filter([{', '.join(ways)}], lambda w: w IS NOT NULL))[1]"


def _finish() -> str:
    ends = []
    for state in STATES:
        gap, name = GAPS[state, "$"], STATE_NAMES[state]
        inserted = "".join(f" || chr(10) || '{ROLES[g]}:'" for g in gap)
        ends.append(f"{{'c': x.{name}.c + {INSERT * len(gap)}, 'a': x.{name}.a || '{'I' * len(gap)}', 'o': x.{name}.o{inserted}}}")
    return f"list_sort([{', '.join(ends)}])[1]"


def _start(state: str) -> str:
    return f"'{STATE_NAMES[state]}': {{'c': {FAR if state else 0}::BIGINT, 'a': '', 'o': ''}}"


ORACLE_SQL = rf"""
WITH RECURSIVE given AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k
  FROM conversations
), hit AS (
  SELECT conv_id, turn, role, text, {_CRC} % 20 AS h FROM given
), harmed AS (
  SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN h = 1 THEN '' WHEN h = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM hit, unnest(CASE h WHEN 0 THEN []::INT[] WHEN 3 THEN [1, 2] ELSE [1] END) AS copies(copy)
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST) > 1 AS again FROM harmed
), placed AS (
  SELECT *, row_number() OVER w AS i, lag(role[1]) OVER w || role[1] AS step
  FROM numbered WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, again)
), judged AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN again THEN 'duplicate'
    WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 'truncated' ELSE 'none' END AS fault
  FROM placed
), turns AS (
  SELECT conv_id, i, role, text, role[1] AS ini, fault NOT IN ('blank', 'duplicate') AS stays, (fault = 'truncated')::INT AS late FROM judged
), walk AS (
  SELECT conv_id, 0::BIGINT AS i, {{{', '.join(_start(s) for s in STATES)}}} AS x FROM (SELECT DISTINCT conv_id FROM given)
  UNION ALL
  SELECT w.conv_id, t.i, {{{', '.join(_step(s) for s in STATES)}}} FROM walk w JOIN turns t ON t.conv_id IS NOT DISTINCT FROM w.conv_id AND t.i = w.i + 1
), ended AS (
  SELECT conv_id, {_finish()} AS best FROM walk QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) = 1
), stats AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
    count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (step NOT IN ('su', 'ua', 'au')) AS illegal
  FROM judged GROUP BY conv_id
)
SELECT e.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, best.c AS cost, best.a AS audit, sha256(best.o[2:]) AS repaired_sha256
FROM ended e LEFT JOIN stats s ON s.conv_id IS NOT DISTINCT FROM e.conv_id
"""
