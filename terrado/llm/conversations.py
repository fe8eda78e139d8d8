"""Conversation structure repair by a scan with min-plus matrices.

A repaired conversation's role initials are `(s?(ua)+)?`, an automaton of four
states: start, after system, after user, after assistant. Each turn is a 4x4
matrix: entry (i, j) is the cheapest edit that takes the turn from state i to j,
as (cost, audit), with the closure of insertions before it. Elements are compared
by cost, then by audit, and multiplied by adding costs and joining audits; of two
audits with one cost over the same turns none begins the other, so the order
survives joining and the product is associative.

Turns are dealt by ranges of (conversation, turn), so a very long conversation
lies in many partitions. Each task multiplies its runs of one conversation as a
balanced tree; runs that a partition's edge cuts, two a partition at most, are
multiplied in rounds over bounded groups. Only turns' keys and digests move up to
there. Texts move once, to be edited: a conversation's rows stream in order
through one task, a batch at a time (its digest, SHA-256, is a sequential sum).
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from terrado.llm.common import drop_table, few, let, materialize, slices

WHITE = " \t\n\x0b\x0c\r"
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: States: 0 start, 1 after system, 2 after user, 3 after assistant; where a turn of a role leads.
MOVES = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
ENDS = (0, 3)
ROLES = {"u": "user", "a": "assistant"}
#: Turns in a block whose product a worker remembers; runs that a round multiplies in one group.
BLOCK, FAN = 16, 32
#: A turn that must go: blank or repeated. Others are their role's initial, or `o`; upper case: truncated.
GONE = "x"

Matrix = tuple  # of 16 entries: None or (cost, audit)


def _matrix(entries: dict[tuple[int, int], tuple[int, str]]) -> Matrix:
    return tuple(entries.get((i, j)) for i in range(4) for j in range(4))


UNIT = _matrix({(i, i): (0, "") for i in range(4)})


def product(a: Matrix, b: Matrix) -> Matrix:
    """The cheapest way through a, then b; of equal costs the audit that is least in ASCII."""
    out = [None] * 16
    for i in range(4):
        for k in range(4):
            left = a[4 * i + k]
            if left is None:
                continue
            for j in range(4):
                right = b[4 * k + j]
                if right is None:
                    continue
                cost, have = left[0] + right[0], out[4 * i + j]
                if have is None or cost < have[0]:
                    out[4 * i + j] = (cost, left[1] + right[1])
                elif cost == have[0]:
                    out[4 * i + j] = min(have, (cost, left[1] + right[1]))
    return tuple(out)


def _closure() -> Matrix:
    """Any number of insertions: three steps visit every state."""
    once = {(i, j): (INSERT, "I") for role in ROLES for i, j in MOVES[role].items()}
    step = _matrix({(i, i): (0, "") for i in range(4)} | once)
    return product(product(step, step), step)


CLOSURE = _closure()


@lru_cache(maxsize=None)
def turn_matrix(code: str) -> Matrix:
    """Insertions, then one turn of this code kept, given another role or deleted."""
    entries = {(i, i): (DELETE, "D") for i in range(4)}
    if code != GONE:
        more = TRUNCATED if code.isupper() else 0
        for role, moves in MOVES.items():
            if role == code.lower():
                entries |= {m: (KEEP + more, "K") for m in moves.items()}
            elif role in ROLES:
                entries |= {m: (REROLE + more, "R") for m in moves.items()}
    return product(CLOSURE, _matrix(entries))


@lru_cache(maxsize=1 << 14)
def block_matrix(codes: str) -> Matrix:
    """The product of at most BLOCK turns; conversations repeat such blocks."""
    out = UNIT
    for code in codes:
        out = product(out, turn_matrix(code))
    return out


def power(matrix: Matrix, n: int) -> Matrix:
    out = UNIT
    while n:
        if n & 1:
            out = product(out, matrix)
        matrix, n = product(matrix, matrix) if n > 1 else matrix, n >> 1
    return out


class Tree:
    """A product in order, as a balanced tree: parts of like size are multiplied first, so audits are copied log n times."""

    def __init__(self) -> None:
        self.parts: list[tuple[int, Matrix]] = []
        self.codes = ""

    def turns(self, code: str, n: int) -> None:
        if n <= BLOCK:
            self.codes += code * n
        else:
            self._flush()
            self._push(n, power(turn_matrix(code), n))
        if len(self.codes) >= BLOCK:
            self._flush()

    def _flush(self) -> None:
        for at in range(0, len(self.codes), BLOCK):
            block = self.codes[at : at + BLOCK]
            self._push(len(block), block_matrix(block))
        self.codes = ""

    def _push(self, size: int, matrix: Matrix) -> None:
        self.parts.append((size, matrix))
        while len(self.parts) > 1 and self.parts[-2][0] <= self.parts[-1][0]:
            self._join()

    def _join(self) -> None:
        (n, a), (m, b) = self.parts[-2:]
        self.parts[-2:] = [(n + m, product(a, b))]

    def whole(self) -> Matrix:
        self._flush()
        while len(self.parts) > 1:
            self._join()
        return self.parts[0][1] if self.parts else UNIT


def cheapest(matrix: Matrix) -> tuple[int, str]:
    """Cost and audit from the start to a state in which a conversation may end."""
    closed = product(matrix, CLOSURE)
    return min(closed[j] for j in ENDS if closed[j] is not None)


# what a run of turns has besides its matrix ----------------------------------------------------

COUNTS = ("blank", "duplicate", "truncated", "illegal", "n_turns")
#: Fields of a run, in the order of the frames that carry it.
RUN = {c: pa.int64() for c in COUNTS} | {
    "first_turn": pa.int64(), "last_turn": pa.int64(), "first_role": pa.string(), "last_role": pa.string(),
    "cost": pa.int64(), "audit": pa.string(), "costs": pa.list_(pa.int64()), "audits": pa.list_(pa.string()),
}
RUN_DDL = ", ".join(f"{c} long" for c in COUNTS) + (
    ", first_turn long, last_turn long, first_role string, last_role string, cost long, audit string, costs array<long>, audits array<string>"
)
LEGAL = {"su", "ua", "au"}


def _open() -> dict:
    return dict.fromkeys(RUN) | dict.fromkeys(COUNTS, 0)


def _close(run: dict, matrix: Matrix, whole: bool) -> dict:
    if whole:
        cost, audit = cheapest(matrix)
        return run | {"cost": cost, "audit": audit}
    return run | {"costs": [None if e is None else e[0] for e in matrix], "audits": [None if e is None else e[1] for e in matrix]}


def _add(run: dict, tree: Tree, row: dict) -> None:
    """Rows that are alike count n times: the first has its own fault, the others are blank or repeat it."""
    n, turn, role = row["n"], row["turn"], row["initial"]
    if not n:
        return
    gone = row["blank"] or row["later"]
    cut = not gone and row["cut"]
    run["blank"] += n if row["blank"] else 0
    run["duplicate"] += 0 if row["blank"] else n if row["later"] else n - 1
    run["truncated"] += int(cut)
    if run["last_role"] is not None and run["last_role"] + role not in LEGAL:
        run["illegal"] += 1
    run["illegal"] += n - 1  # no role may follow itself
    if turn is not None and turn != run["last_turn"]:
        run["n_turns"] += 1
    if turn is not None:
        run["first_turn"], run["last_turn"] = turn if run["first_turn"] is None else run["first_turn"], turn
    run["first_role"], run["last_role"] = role if run["first_role"] is None else run["first_role"], role
    code = role if role in MOVES else "o"
    tree.turns(GONE if gone else code.upper() if cut else code, 1)
    if n > 1:
        tree.turns(GONE, n - 1)


def _join_runs(a: dict, b: dict) -> dict:
    out = {c: a[c] + b[c] for c in COUNTS}
    if a["last_role"] is not None and b["first_role"] is not None and a["last_role"] + b["first_role"] not in LEGAL:
        out["illegal"] += 1
    if a["last_turn"] is not None and a["last_turn"] == b["first_turn"]:
        out["n_turns"] -= 1
    for name, one, other in (("first_turn", a, b), ("last_turn", b, a), ("first_role", a, b), ("last_role", b, a)):
        out[name] = other[name] if one[name] is None else one[name]
    return out


# the frames ------------------------------------------------------------------------------------


def damage(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, turn, role, text, n (copies; 0: the row is dropped): a defined part of the rows, by crc32 of `conv_id:turn` modulo 20, is damaged.

    0 drops the row, 1 empties its text, 2 takes `.`, `!` and `?` from it, 3 makes
    a copy, 4 sets the role to user. A null of any column counts as one space.
    """
    conv, turn, role, text = (F.col(f"`{c}`") for c in (conv_col, turn_col, role_col, text_col))
    blank = F.lit(" ")
    name = F.concat(F.coalesce(conv.cast("string"), blank), F.lit(":"), F.coalesce(turn.cast("string"), blank))
    kind = F.crc32(name.cast("binary")) % 20
    found = df.select(
        conv.alias("conv_id"), turn.cast("long").alias("turn"), F.coalesce(role.cast("string"), blank).alias("role"), F.coalesce(text.cast("string"), blank).alias("text"), kind.alias("kind")
    )
    return found.select(
        "conv_id",
        "turn",
        F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.when(F.col("kind") == 0, 0).when(F.col("kind") == 3, 2).otherwise(1).cast("long").alias("n"),
    )


def turn_digest() -> Column:
    """What stands for a turn's role and text: SHA-256 of both, parted by the role's length."""
    return F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.lit(":"), F.col("text")).cast("binary"), 256))


def _keys(turns: DataFrame) -> DataFrame:
    """One slim row for each (conversation, turn, role and text), with its number of copies; dropped rows keep their conversation only."""
    there = F.col("n") > 0
    last = F.rtrim(F.col("text"), F.lit(WHITE))
    facts = let(last, lambda t: F.struct((t == "").alias("blank"), (~F.substring(t, -1, 1).isin(".", "!", "?")).alias("cut")))
    rows = turns.select(
        "conv_id",
        F.when(there, F.col("turn")).alias("turn"),
        F.when(there, turn_digest()).alias("digest"),
        F.when(there, F.substring("role", 1, 1)).alias("initial"),
        F.when(there, facts).alias("facts"),
        "n",
    )
    return rows.groupBy("conv_id", "turn", "digest").agg(
        F.first("initial").alias("initial"), F.first("facts.blank").alias("blank"), F.first("facts.cut").alias("cut"), F.sum("n").alias("n")
    )


def _repeated(keys: DataFrame) -> DataFrame:
    """conv_id, digest, first (the earliest turn) of what stands at more than one turn."""
    texts = keys.where("n > 0 and not blank").groupBy("conv_id", "digest")
    return texts.agg(F.min(F.struct("turn")).alias("first"), F.count("*").alias("times")).where("times > 1").drop("times")


def _marked(keys: DataFrame, again: DataFrame) -> DataFrame:
    """Keys with `later`: the same role and text has stood at an earlier turn."""
    again = few(again).select(F.col("conv_id").alias("_conv"), F.col("digest").alias("_digest"), "first")
    same = F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("digest") == F.col("_digest"))
    later = F.col("first").isNotNull() & ~F.col("first.turn").eqNullSafe(F.col("turn"))
    return keys.join(again, same, "left").withColumn("later", later).drop("_conv", "_digest", "first")


def _fold(fields: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows in order to one run for each conversation of the partition; the first and the last may go on beyond it."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, nobody = TaskContext.get().partitionId(), object()
        conv, run, tree, runs, kind, first = nobody, None, None, [], None, True

        def packed(done: list[tuple]) -> pa.RecordBatch:
            arrays = [pa.array([c for c, _, _ in done], kind), pa.array([part] * len(done), pa.int64()), pa.array([e for _, e, _ in done], pa.bool_())]
            return pa.RecordBatch.from_arrays(arrays + [pa.array([r[f] for _, _, r in done], t) for f, t in RUN.items()], names=fields)

        for batch in batches:
            kind = batch.schema.field("conv_id").type
            for row in batch.to_pylist():
                if row["conv_id"] != conv or conv is nobody:
                    if conv is not nobody:
                        runs.append((conv, first, _close(run, tree.whole(), not first)))
                        first = False
                    conv, run, tree = row["conv_id"], _open(), Tree()
                _add(run, tree, row)
            if len(runs) > 1000:
                yield packed(runs)
                runs = []
        if conv is not nobody:
            runs.append((conv, True, _close(run, tree.whole(), False)))
            yield packed(runs)

    return fold


def _merge(last: bool) -> Callable[[pa.Table], pa.Table]:
    """Runs of one conversation that follow each other to one run."""

    def merge(runs: pa.Table) -> pa.Table:
        rows = sorted(runs.to_pylist(), key=lambda r: r["part"])
        matrices = [tuple(None if c is None else (c, a) for c, a in zip(r["costs"], r["audits"], strict=True)) for r in rows]
        whole = rows[0]
        for row in rows[1:]:
            whole = _join_runs(whole, row)
        while len(matrices) > 1:
            matrices = [product(*matrices[i : i + 2]) if i + 1 < len(matrices) else matrices[i] for i in range(0, len(matrices), 2)]
        made = {"conv_id": rows[0]["conv_id"], "part": rows[0]["part"], "edge": not last} | _close(_open() | {c: whole[c] for c in RUN if c in whole}, matrices[0], last)
        if last:
            made |= {"costs": None, "audits": None}
        return pa.Table.from_pylist([made], schema=pa.schema([runs.schema.field("conv_id"), ("part", pa.int64()), ("edge", pa.bool_()), *RUN.items()]))

    return merge


def _judged(turns: DataFrame) -> DataFrame:
    """conv_id, the run's facts, cost and audit: one row for each conversation."""
    spark = turns.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = materialize(_keys(turns))
    again = materialize(_repeated(keys))
    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "digest")]
    dealt = _marked(keys, again).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    conv = dealt.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {conv}, part long, edge boolean, {RUN_DDL}"
    runs = materialize(dealt.mapInArrow(_fold(["conv_id", "part", "edge", *RUN]), schema))
    drop_table(keys)
    drop_table(again)
    edges, span = runs.where("edge"), 1
    parts = (runs.agg(F.max("part")).first()[0] or 0) + 1
    while span < parts:  # a conversation's runs are at most one a partition
        span *= FAN
        last = span >= parts
        edges = edges.groupBy("conv_id", F.floor(F.col("part") / span).alias("span")).applyInArrow(_merge(last), schema)
        edges = edges if last else materialize(edges)
    if parts == 1:
        edges = edges.groupBy("conv_id").applyInArrow(_merge(True), schema)
    return runs.where("not edge").unionByName(edges).drop("part", "edge", "costs", "audits", "first_role", "last_role")


FACTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def _ordered(turns: DataFrame) -> DataFrame:
    """Each conversation's facts and audit (kind 0), then its turns (kind 1) in order, in one partition."""
    facts = _judged(turns).withColumn("gaps", F.coalesce(F.expr("last_turn - first_turn + 1 - n_turns"), F.lit(0)))
    head = facts.select("conv_id", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"), F.lit(None).cast("binary").alias("digest"), F.lit(None).cast("string").alias("role"), F.col("audit").alias("text"), F.lit(0).cast("long").alias("n"), *FACTS)
    rows = turns.where("n > 0").select("conv_id", F.lit(1).alias("kind"), "turn", turn_digest().alias("digest"), "role", "text", "n", *(F.lit(None).cast("long").alias(c) for c in FACTS))
    every = head.unionByName(rows).repartition("conv_id")
    return every.sortWithinPartitions("conv_id", "kind", F.col("turn").asc_nulls_first(), "digest").drop("digest")


class Walk:
    """Applies an audit to a conversation's turns as they come."""

    def __init__(self, audit: str):
        self.audit, self.at, self.made, self.system = audit, 0, 0, 0

    def _role(self) -> str:
        self.made += 1
        return ROLES["ua"[(self.made - 1 - self.system) % 2]]

    def inserted(self) -> Iterator[tuple[str, str, str]]:
        """Turns that the audit puts in here: (edit, role, text)."""
        while self.audit[self.at : self.at + 1] == "I":
            self.at += 1
            yield "I", self._role(), ""

    def turn(self, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        yield from self.inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            self.system += int(self.made == 0 and role[:1] == "s")
            self.made += 1
            yield edit, role, text
        elif edit == "R":
            yield edit, self._role(), text


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict | None, Iterator[tuple[str, str, str]]]]:
    """(facts of a new conversation, or None; the repaired turns that follow), over a partition in order."""
    walk = None
    for batch in slices(batches, 256):
        for row in batch.to_pylist():
            if row["kind"] == 0:
                if walk:
                    yield None, walk.inserted()
                walk = Walk(row["text"])
                yield row, iter(())
            else:
                for _ in range(row["n"]):
                    yield None, walk.turn(row["role"], row["text"])
    if walk:
        yield None, walk.inserted()


def repair_conversations(df: DataFrame, **columns: str) -> DataFrame:
    """conv_id, position (from 0), role, text, edit: the repaired turns of all conversations. See `repair_report` for the rules."""
    turns = damage(df, **columns)
    conv = turns.schema["conv_id"].dataType
    fields = pa.schema({"conv_id": to_arrow_type(conv), "position": pa.int64(), "role": pa.string(), "text": pa.string(), "edit": pa.string()})

    def repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv_id, position, out = None, 0, []
        for facts, edits in _edited(batches):
            if facts:
                conv_id, position = facts["conv_id"], 0
            for edit, role, text in edits:
                out.append({"conv_id": conv_id, "position": position, "role": role, "text": text, "edit": edit})
                position += 1
            if len(out) >= 256:
                yield pa.RecordBatch.from_pylist(out, schema=fields)
                out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=fields)

    return _ordered(turns).mapInArrow(repaired, f"conv_id {conv.simpleString()}, position long, role string, text string, edit string")


def repair_report(df: DataFrame, **columns: str) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256: one row for each conversation.

    Rows are damaged first (`damage`), then taken by turn, nulls first; rows with
    one turn by the digest of role and text, so the order of the input plays no
    part. A row's first fault counts: blank (white space only), duplicate (role and
    text stood earlier), truncated (the last other character is none of `.!?`).
    Keeping costs 0, another role (user or assistant) 3, deletion 4 and an empty
    turn put in 3; blank and duplicate rows must go, truncated ones that stay cost
    3 more. The audit has the edits' initials in order. gaps: turns missing between
    the least and the greatest (nulls play no part; all null: 0). illegal: pairs of
    neighbours whose initials are not su, ua or au.

    A conversation whose rows are all dropped has zeros, an empty audit and the
    digest of the empty text. A null conv_id is a conversation. Roles with another
    initial than s, u or a can't be kept. Empty table: no rows. Other columns play
    no part, whatever their names.
    """
    turns = damage(df, **columns)
    conv = turns.schema["conv_id"].dataType
    fields = pa.schema({"conv_id": to_arrow_type(conv)} | dict.fromkeys(FACTS, pa.int64()) | dict.fromkeys(("audit", "repaired_sha256"), pa.string()))

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, sha, any_yet, out = None, None, False, []
        for facts, edits in _edited(batches):
            if facts:
                if head:
                    out.append(head | {"repaired_sha256": sha.hexdigest()})
                head, sha, any_yet = {c: facts[c] for c in ("conv_id", *FACTS)} | {"audit": facts["text"]}, hashlib.sha256(), False
            for _, role, text in edits:
                sha.update(f"{chr(10) if any_yet else ''}{role}:{text}".encode())
                any_yet = True
            if len(out) >= 4096:
                yield pa.RecordBatch.from_pylist(out, schema=fields)
                out = []
        if head:
            yield pa.RecordBatch.from_pylist([*out, head | {"repaired_sha256": sha.hexdigest()}], schema=fields)

    return _ordered(turns).mapInArrow(digests, f"conv_id {conv.simpleString()}, {', '.join(f'{c} long' for c in FACTS)}, audit string, repaired_sha256 string")


def crc32_sql(text: str) -> str:
    """DuckDB has no crc32: bit by bit over an ASCII text, each byte followed by eight steps."""
    steps = f"list_prepend(4294967295, flatten([[ord(x), -1, -1, -1, -1, -1, -1, -1, -1] FOR x IN string_split({text}, '')]))"
    return f"xor(list_reduce({steps}, lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, 3988292384 * (c & 1)) END), 4294967295)"


def _step_sql() -> dict[str, str]:
    """The states after one more row (columns code and initial) and any insertions, each state as nine digits of cost and an audit."""

    def more(state: str, cost: str | int, letter: str) -> str:
        return f"lpad(CAST(CAST(substr({state}, 1, 9) AS BIGINT) + {cost} AS VARCHAR), 9, '0') || substr({state}, 10) || '{letter}'"

    found: dict[int, list[str]] = {j: [more(f"s{j}", DELETE, "D")] for j in range(4)}
    for role, moves in MOVES.items():
        for i, j in moves.items():
            extra = f"CASE WHEN fault = 'truncated' THEN {TRUNCATED} ELSE 0 END"
            keep = more(f"s{i}", f"({KEEP} + {extra})", "K")
            change = more(f"s{i}", f"({REROLE} + {extra})", "R") if role in ROLES else "NULL"
            found[j].append(f"CASE WHEN coalesce(fault, '') IN ('blank', 'duplicate') THEN NULL WHEN initial = '{role}' THEN {keep} ELSE {change} END")
    return {f"t{j}": f"least({', '.join(x)}, NULL)" for j, x in found.items()} | {
        f"s{j}": f"least({', '.join(more(f't{i}', *CLOSURE[4 * i + j]) for i in range(4) if CLOSURE[4 * i + j])}, NULL)"
        for j in range(4)
    }


def report_sql() -> str:
    step = _step_sql()
    kind = crc32_sql("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")
    start = ", ".join(f"'{CLOSURE[j][0]:09d}{CLOSURE[j][1]}' AS s{j}" if CLOSURE[j] else f"CAST(NULL AS VARCHAR) AS s{j}" for j in range(4))
    return f"""
WITH RECURSIVE given AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {kind} % 20 AS kind FROM conversations),
damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM given, LATERAL unnest(range(0, CASE WHEN kind = 0 THEN 0 WHEN kind = 3 THEN 2 ELSE 1 END)) AS r(copy)),
placed AS (
  SELECT *, substr(role, 1, 1) AS initial, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(role) || ':' || role || ':' || text)) AS pos,
    regexp_replace(text, '[ \\t\\n\\x0B\\f\\r]+$', '') AS cut FROM damaged),
judged AS MATERIALIZED (
  SELECT *, CASE WHEN cut = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 THEN 'duplicate' WHEN right(cut, 1) NOT IN ('.', '!', '?') THEN 'truncated' END AS fault,
    lag(initial) OVER (PARTITION BY conv_id ORDER BY pos) || initial AS pair FROM placed),
facts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank,
    count(*) FILTER (WHERE fault = 'duplicate') AS duplicate, count(*) FILTER (WHERE fault = 'truncated') AS truncated,
    count(*) FILTER (WHERE pair IS NOT NULL AND pair NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM judged GROUP BY conv_id),
walk AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS pos, {start} FROM facts
  UNION ALL
  SELECT conv_id, pos, {", ".join(f"{step[f's{j}']} AS s{j}" for j in range(4))}
  FROM (SELECT w.conv_id, j.pos, {", ".join(f"{step[f't{j}']} AS t{j}" for j in range(4))} FROM walk w JOIN judged j ON j.conv_id IS NOT DISTINCT FROM w.conv_id AND j.pos = w.pos + 1)),
best AS (SELECT f.*, least({", ".join(f"s{j}" for j in ENDS)}) AS best FROM facts f JOIN walk w ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND w.pos = f.n),
edits AS (
  SELECT conv_id, i, edit, count(*) FILTER (WHERE edit <> 'I') OVER (PARTITION BY conv_id ORDER BY i) AS pos, count(*) FILTER (WHERE edit <> 'D') OVER (PARTITION BY conv_id ORDER BY i) AS made
  FROM (SELECT conv_id, i, substr(best, 9 + i, 1) AS edit FROM best, LATERAL unnest(range(1, length(best) - 8)) AS r(i))),
outputs AS (
  SELECT e.*, j.role, j.text, CAST(bool_or(edit = 'K' AND made = 1 AND j.initial = 's') OVER (PARTITION BY e.conv_id) AS BIGINT) AS system
  FROM edits e LEFT JOIN judged j ON e.edit <> 'I' AND j.conv_id IS NOT DISTINCT FROM e.conv_id AND j.pos = e.pos WHERE edit <> 'D'),
repaired AS (
  SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN (made - coalesce(system, 0)) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN edit = 'I' THEN '' ELSE text END, chr(10) ORDER BY i) AS whole
  FROM outputs GROUP BY conv_id)
SELECT o.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate,
  CAST(coalesce(truncated, 0) AS BIGINT) AS truncated, CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(substr(best, 1, 9), '0') AS BIGINT) AS cost,
  coalesce(substr(best, 10), '') AS audit, sha256(coalesce(whole, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN repaired r ON r.conv_id IS NOT DISTINCT FROM o.conv_id"""

