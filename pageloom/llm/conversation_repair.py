"""Repair of conversation structure by dynamic programming over a grammar.

A conversation is well formed when the initials of its roles read ``(s?(ua)+)?``. Each row becomes one symbol: the initial of its role and
whether it is truncated, or that it has to go (blank, or role and text were seen earlier). What edits may do to a row is a min-plus transfer
matrix between the four states of that pattern; an entry holds the least cost and, of equally cheap edits, the ASCII-least audit as a rope.
Re-Pair joins the most frequent neighbours of all symbol sequences into rules, a round of disjoint pairs at a time; each rule's matrix is
the product of two known ones, made once, bottom-up, and shared by all conversations. Conversations longer than
``BLOCK`` symbols are cut into blocks, whose matrices are multiplied in groups, so no task sees a whole long conversation. Only the SHA-256 of the
repaired text has to read a conversation from its first row to its last: it streams through sorted rows and holds one batch.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pageloom.llm.common import join_classes
from pageloom.operators.sizing import small_side
from pageloom.session import staged

#: Symbols of a block, matrices multiplied at once.
BLOCK, FAN_IN = 4096, 64
#: Rounds of pair replacement, pairs looked at in one; they bound the grammar, not the result.
ROUNDS, PAIRS = 10, 64
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1

#: States: nothing yet, after system, after user, after assistant. The first and the last may end a conversation.
START, SYSTEM, USER, ASSISTANT = range(4)
#: Where a kept initial leads, by state.
_MOVES = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
#: Where a row that is inserted or gets a new role leads: only one of user and assistant fits.
NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
ROLE = {USER: "user", ASSISTANT: "assistant"}
#: Initials that may stand side by side.
LEGAL = ("su", "ua", "au")
#: A row that has to go; else the initial (``o``: none that fits), in capitals when truncated.
GONE, SYMBOLS = "x", "xsuaoSUAO"


class Rope:
    """A text made of two others; it is spelled out only to be compared or returned, and then once."""

    __slots__ = ("left", "right", "text")

    def __init__(self, text: str | None = None, left: Rope | None = None, right: Rope | None = None):
        self.left, self.right, self.text = left, right, text

    def __add__(self, other: Rope) -> Rope:
        if other.text == "":
            return self
        return other if self.text == "" else Rope(None, self, other)

    def __str__(self) -> str:
        if self.text is None:
            parts, stack = [], [self]
            while stack:
                rope = stack.pop()
                if rope.text is not None:
                    parts.append(rope.text)
                else:
                    stack += (rope.right, rope.left)
            self.text, self.left, self.right = "".join(parts), None, None
        return self.text


Entry = tuple[int, Rope]
Matrix = list[list[Entry | None]]


def better(a: Entry | None, b: Entry | None) -> Entry | None:
    """The cheaper entry, of equally cheap ones that with the least audit. One audit never begins with another of equal cost: it would have more edits."""
    if a is None or b is None:
        return b if a is None else a
    if a[0] != b[0]:
        return a if a[0] < b[0] else b
    return a if a[1] is b[1] or str(a[1]) <= str(b[1]) else b


def product(x: Matrix, y: Matrix) -> Matrix:
    """Min-plus product: the best way from each state to each other through both."""
    out: Matrix = [[None] * 4 for _ in range(len(x))]
    for p, row in enumerate(x):
        for m, first in enumerate(row):
            if first is not None:
                for q, second in enumerate(y[m]):
                    if second is not None:
                        out[p][q] = better(out[p][q], (first[0] + second[0], first[1] + second[1]))
    return out


def insertions() -> Matrix:
    """No or some inserted rows; more than two in a row never pay."""
    out: Matrix = [[None] * 4 for _ in range(4)]
    for state in range(4):
        out[state][state] = (0, Rope(""))
        once = NEXT[state]
        out[state][once] = better(out[state][once], (INSERT, Rope("I")))
        out[state][NEXT[once]] = better(out[state][NEXT[once]], (2 * INSERT, Rope("II")))
    return out


def terminal(symbol: str) -> Matrix:
    """What may happen from the end of the row before to the end of this one: insertions, then an edit of the row."""
    edit: Matrix = [[None] * 4 for _ in range(4)]
    more = TRUNCATED if symbol.isupper() else 0
    for state in range(4):
        edit[state][state] = (DELETE, Rope("D"))
        if symbol == GONE:
            continue
        new = NEXT[state]
        edit[state][new] = better(edit[state][new], (REROLE + more, Rope("R")))
        kept = _MOVES.get(symbol.lower(), {}).get(state)
        if kept is not None:
            edit[state][kept] = better(edit[state][kept], (KEEP + more, Rope("K")))
    return product(insertions(), edit)


def replaced(codes: list[int], rules: dict[tuple[int, int], int]) -> list[int]:
    """The sequence with each pair of ``rules`` as one symbol, from the left."""
    out, k, n = [], 0, len(codes)
    while k < n:
        new = rules.get((codes[k], codes[k + 1])) if k + 1 < n else None
        out.append(codes[k] if new is None else new)
        k += 1 if new is None else 2
    return out


def encode(sequence: str, rounds: list[dict[tuple[int, int], int]]) -> list[int]:
    codes = [SYMBOLS.index(c) for c in sequence]
    for rules in rounds:
        codes = replaced(codes, rules)
    return codes


def pair_counts(codes: list[int]) -> Counter:
    """How often each pair occurs without overlapping itself."""
    found, k = Counter(), 0
    while k + 1 < len(codes):
        found[codes[k], codes[k + 1]] += 1
        # In a run of one symbol every second place counts.
        k += 2 if k + 2 < len(codes) and codes[k] == codes[k + 1] == codes[k + 2] else 1
    return found


def grammar(sequences: DataFrame, rounds: int = ROUNDS, pairs: int = PAIRS) -> list[dict[tuple[int, int], int]]:
    """Re-Pair rules for ``sequences(seq)``, round by round: pair to new symbol.

    A round counts pairs inside the tasks and over all of them, and turns the most frequent ones that share no symbol into rules, so their
    replacements do not disturb each other. Ends when no pair occurs twice. The driver gets at most ``pairs`` pairs a round.
    """
    made: list[dict[tuple[int, int], int]] = []
    size = len(SYMBOLS)
    for _ in range(rounds):

        def count(batches: Iterator[pd.DataFrame], known=tuple(made)) -> Iterator[pd.DataFrame]:
            total: Counter = Counter()
            for batch in batches:
                for sequence in batch["seq"]:
                    total.update(pair_counts(encode(sequence, list(known))))
            yield pd.DataFrame([(a, b, n) for (a, b), n in total.items()], columns=["a", "b", "n"])

        counted = sequences.select("seq").mapInPandas(count, "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))
        best = counted.where("n > 1").orderBy(F.desc("n"), "a", "b").limit(pairs).collect()
        rules: dict[tuple[int, int], int] = {}
        used: set[int] = set()
        for r in best:
            if not used & {r["a"], r["b"]}:
                rules[r["a"], r["b"]] = size
                size += 1
                used |= {r["a"], r["b"]}
        if not rules:
            break
        made.append(rules)
    return made


def rule_matrices(rounds: list[dict[tuple[int, int], int]]) -> list[Matrix]:
    """The transfer matrix of every symbol: those of rows, then each rule's from its two parts."""
    out = [terminal(c) for c in SYMBOLS]
    for rules in rounds:
        for a, b in rules:
            out.append(product(out[a], out[b]))
    return out


def evaluate(codes: list[int], matrices: list[Matrix]) -> Matrix:
    """The matrix of a sequence, by halves, so ropes stay shallow."""
    if not codes:
        none: Matrix = [[None] * 4 for _ in range(4)]
        for state in range(4):
            none[state][state] = (0, Rope(""))
        return none
    layer = [matrices[c] for c in codes]
    while len(layer) > 1:
        layer = [product(layer[k], layer[k + 1]) if k + 1 < len(layer) else layer[k] for k in range(0, len(layer), 2)]
    return layer[0]


def finished(matrix: Matrix) -> Entry:
    """The best way from nothing to a state that may end, rows inserted at the end included."""
    last = product(matrix[:1], insertions())[0]
    return better(last[START], last[ASSISTANT])


def _flat(matrix: Matrix) -> tuple[list, list]:
    entries = [e for row in matrix for e in row]
    return [None if e is None else e[0] for e in entries], [None if e is None else str(e[1]) for e in entries]


def _unflat(costs, audits) -> Matrix:
    entries = [None if a is None else (int(c), Rope(a)) for c, a in zip(costs, audits)]
    return [entries[4 * k : 4 * k + 4] for k in range(4)]


#: What a conv_id may be.
_ID_TYPES = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}
_MATRIX = "costs array<long>, audits array<string>"
_WHITE = r"[\x20\x09-\x0D]"


def damaged(conversations: DataFrame) -> DataFrame:
    """``conversations(conv_id, turn, role, text)`` with the faults of a fixed test: the crc32 of ``conv_id:turn`` modulo 20 decides.

    0 drops a row, 1 empties its text, 2 takes out its ``.!?``, 3 repeats it, 4 makes its role user. A NULL is one space, in the hash too.
    """
    blank = F.lit(" ")
    named = conversations.select("conv_id", "turn", F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text"))
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))
    marked = named.withColumn("kind", F.crc32(key.cast("binary")) % 20).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    return marked.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.when(F.col("kind") == 3, 2).otherwise(1).alias("n"))


def _initial(role: Column) -> Column:
    first = F.left(role, F.lit(1))
    return F.when(first.isin("s", "u", "a"), first).otherwise("o")


def classified(rows: DataFrame) -> DataFrame:
    """Distinct rows (conv_id, turn, role, text, n, fault, initial): ``fault`` is that of the first of ``n`` equal rows; the others are duplicates.

    Equal rows are counted before the shuffle. That a row's role and text stand at an earlier turn follows from the least turn of each
    (conversation, role, digest of the text); only those at several turns are joined back.
    """
    met = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("n").alias("n"))
    last = F.right(F.regexp_replace("text", f"{_WHITE}+$", ""), F.lit(1))
    met = staged(met.withColumns({"last": last, "digest": F.sha2(F.col("text").cast("binary"), 256)}), "turns")
    place = F.struct(F.col("turn").isNotNull().alias("has_turn"), "turn")
    seen = met.where("last <> ''").groupBy("conv_id", "role", "digest").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("places")).where("places > 1")
    seen = staged(seen.select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d"), "first"), "repeated-turns")
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d"))
    fault = (
        F.when(F.col("last") == "", "blank")
        .when(F.col("first").isNotNull() & (F.col("first") < place), "duplicate")
        .when(~F.col("last").isin(".", "!", "?"), "truncated")
    )
    return met.join(small_side(seen), same, "left").select("conv_id", "turn", "role", "text", "n", fault.alias("fault"), _initial(F.col("role")).alias("initial"))


def _legal(pair: Column) -> Column:
    return pair.isin(*LEGAL)


def symbol_blocks(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """(conv_id, part, block, seq, first, last, illegal): the symbols of conversations in order, in blocks.

    Rows are put in order over all tasks by (conversation, turn, role, text), so a long conversation lies in several; ``part`` is the task.
    """

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        out: list[tuple] = []
        at, number, seq, size, first, last, illegal = None, 0, [], 0, None, None, 0

        def flush():
            nonlocal number, seq, size, illegal
            out.append((at[0], part, number, "".join(seq), first, last, illegal))
            number, seq, size, illegal = number + 1, [], 0, 0

        for batch in batches:
            for conv, symbol, initial, n in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "symbol", "initial", "n"))):
                if at is None or at[0] != conv:
                    if size:
                        flush()
                    at, number = (conv,), 0
                # The copies after the first of equal rows have to go.
                for kind, count in ((symbol, 1), (GONE, n - 1)):
                    while count:
                        take = min(count, block - size)
                        if size:
                            illegal += last + initial not in LEGAL
                        else:
                            first = initial
                        illegal += take - 1  # a role never follows itself
                        seq.append(kind * take)
                        size, count, last = size + take, count - take, initial
                        if size == block:
                            flush()
            if len(out) >= 1000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)
                out = []
        if size:
            flush()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)

    name = rows.schema["conv_id"].dataType.simpleString()
    schema = pa.schema([("conv_id", _ID_TYPES[name]), ("part", pa.int32()), ("block", pa.int32()), ("seq", pa.string()), ("first", pa.string()), ("last", pa.string()), ("illegal", pa.int64())])
    gone = F.col("fault").isin("blank", "duplicate")
    symbol = F.when(gone, GONE).when(F.col("fault") == "truncated", F.upper("initial")).otherwise(F.col("initial"))
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text"]
    ordered = rows.withColumn("symbol", symbol).repartitionByRange(*order).sortWithinPartitions(*order)
    return ordered.select("conv_id", "symbol", "initial", "n").mapInArrow(blocks, f"conv_id {name}, part int, block int, seq string, first string, last string, illegal long")


def sequence_matrices(sequences: DataFrame) -> DataFrame:
    """(seq_key, costs, audits): the 4 x 4 matrix of each distinct sequence of ``sequences(seq, seq_key)``, through one grammar for all."""
    rounds = grammar(sequences)
    shared = sequences.sparkSession.sparkContext.broadcast((rounds, [_flat(m) for m in rule_matrices(rounds)]))

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rules, flat = shared.value
        matrices = [_unflat(*m) for m in flat]
        for batch in batches:
            found = [_flat(evaluate(encode(s, rules), matrices)) for s in batch["seq"]]
            yield pd.DataFrame({"seq_key": batch["seq_key"], "n": batch["n"], "costs": [f[0] for f in found], "audits": [f[1] for f in found]})

    return sequences.mapInPandas(solve, f"seq_key string, n long, {_MATRIX}")


def cheapest_edits(blocks: DataFrame) -> DataFrame:
    """(conv_id, cost, audit) from ``blocks(conv_id, k, seq)``, ``k`` counting a conversation's blocks from 0."""
    keyed = blocks.select("conv_id", "k", F.sha2(F.col("seq").cast("binary"), 256).alias("seq_key"), "seq")
    distinct = staged(keyed.groupBy("seq_key").agg(F.first("seq").alias("seq"), F.count(F.lit(1)).alias("n")), "sequences")
    solved = staged(sequence_matrices(distinct), "sequence-matrices")
    level = staged(join_classes(keyed.drop("seq"), solved, ["seq_key"]).select("conv_id", "k", "costs", "audits"), "block-matrices")
    while level.where("k > 0").take(1):
        # Blocks that are alone go on as they are; the others are multiplied by groups of neighbours.
        grouped = level.groupBy("conv_id", F.floor(F.col("k") / FAN_IN).cast("long").alias("k")).agg(F.array_sort(F.collect_list(F.struct("k", "costs", "audits"))).alias("parts"))

        def multiply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                made = []
                for parts in batch["parts"]:
                    matrix = _unflat(parts[0]["costs"], parts[0]["audits"])
                    for part in parts[1:]:
                        matrix = product(matrix, _unflat(part["costs"], part["audits"]))
                    made.append(_flat(matrix))
                yield pd.DataFrame({"conv_id": batch["conv_id"].astype(object).where(batch["conv_id"].notna(), None), "k": batch["k"], "costs": [m[0] for m in made], "audits": [m[1] for m in made]})

        name = level.schema["conv_id"].dataType.simpleString()
        level = staged(grouped.mapInPandas(multiply, f"conv_id {name}, k long, {_MATRIX}"), "block-matrices")

    @F.pandas_udf("cost long, audit string")
    def ended(costs: pd.Series, audits: pd.Series) -> pd.DataFrame:
        found = [finished(_unflat(c, a)) for c, a in zip(costs, audits)]
        return pd.DataFrame({"cost": [f[0] for f in found], "audit": [str(f[1]) for f in found]})

    return level.select("conv_id", ended("costs", "audits").alias("e")).select("conv_id", "e.cost", "e.audit")


_NUMBERS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def _repaired(audit: str, state: int, op: int, role: str, text: str) -> tuple[int, int, list[str]]:
    """Edits up to and with that of one row: the new place in the audit, the new state, the lines that come out."""
    lines = []
    while op < len(audit) and audit[op] == "I":
        state = NEXT[state]
        lines.append(f"{ROLE[state]}:")
        op += 1
    edit = audit[op]
    if edit == "R":
        state = NEXT[state]
        lines.append(f"{ROLE[state]}:{text}")
    elif edit == "K":
        state = _MOVES[role[0]][state]
        lines.append(f"{role}:{text}")
    return op + 1, state, lines


def repaired_hashes(heads: DataFrame, rows: DataFrame) -> DataFrame:
    """``heads(conv_id, audit, ...)`` with ``repaired_sha256``: rows stream past in order behind the head of their conversation."""

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        head, op, state, digest, some = None, 0, START, None, False

        def add(lines):
            nonlocal some
            for line in lines:
                digest.update((("\n" if some else "") + line).encode("utf-8", "surrogatepass"))
                some = True

        def close():
            nonlocal op, state
            while op < len(head[-1]):  # what is inserted behind the last row
                state = NEXT[state]
                add([f"{ROLE[state]}:"])
                op += 1
            out.append((*head, digest.hexdigest()))

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("conv_id", "kind", *_NUMBERS, "audit", "role", "text", "n")]
            for conv, kind, *numbers, audit, role, text, n in zip(*columns):
                if kind == 0:
                    if head is not None:
                        close()
                    head, op, state, digest, some = (conv, *numbers, audit), 0, START, hashlib.sha256(), False
                    continue
                for _ in range(n):
                    op, state, lines = _repaired(head[-1], state, op, role, text)
                    add(lines)
            if len(out) >= 1000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)
                out = []
        if head is not None:
            close()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)

    name = heads.schema["conv_id"].dataType.simpleString()
    schema = pa.schema([("conv_id", _ID_TYPES[name]), *((c, pa.int64()) for c in _NUMBERS), ("audit", pa.string()), ("repaired_sha256", pa.string())])
    first = heads.select("conv_id", *_NUMBERS, "audit").withColumn("kind", F.lit(0))
    mixed = first.unionByName(rows.select("conv_id", "turn", "role", "text", "n").withColumn("kind", F.lit(1)), allowMissingColumns=True)
    order = [F.col("conv_id").asc_nulls_first(), "kind", F.col("turn").asc_nulls_first(), "role", "text"]
    ddl = ", ".join([f"conv_id {name}", *(f"{c} long" for c in _NUMBERS), "audit string", "repaired_sha256 string"])
    return mixed.repartition("conv_id").sortWithinPartitions(*order).mapInArrow(stream, ddl)


def repair(rows: DataFrame, conversations: DataFrame, block: int = BLOCK) -> DataFrame:
    """A row for each conv_id of ``conversations``, from ``rows(conv_id, turn, role, text, n)``, where ``n`` equal rows stand side by side.

    (conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256). Rows are taken by turn, NULL first, and at one turn by role and
    text. NULL conv_ids are one conversation. A role that begins with none of s, u, a (an empty one too) fits nowhere: it gets
    a new role or goes. A conversation without rows has zeros, an empty audit and the hash of the empty text. An empty table gives an empty
    result; other columns are ignored.
    """
    rows = staged(classified(rows), "classified-turns")
    ids = conversations.select("conv_id").distinct()
    blocks = staged(symbol_blocks(rows, block), "symbol-blocks")
    along = Window.partitionBy("conv_id").orderBy("part", "block")
    before = F.concat(F.lag("last").over(along), F.col("first"))
    numbered = blocks.withColumns({"k": F.row_number().over(along) - 1, "met": F.when(before.isNotNull() & ~_legal(before), 1).otherwise(0)})
    numbered = staged(numbered.select("conv_id", F.col("k").cast("long").alias("k"), "seq", (F.col("illegal") + F.col("met")).alias("illegal")), "numbered-blocks")
    edits = cheapest_edits(numbered)
    counts = rows.groupBy("conv_id").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn"), F.lit(0)).cast("long").alias("gaps"),
        F.sum(F.when(F.col("fault") == "blank", F.col("n")).otherwise(0)).alias("blank"),
        F.sum(F.when(F.col("fault") == "duplicate", F.col("n")).when(F.col("fault") == "blank", 0).otherwise(F.col("n") - 1)).alias("duplicate"),
        F.count_if(F.col("fault") == "truncated").alias("truncated"),
    )
    illegal = numbered.groupBy("conv_id").agg(F.sum("illegal").alias("illegal"))
    heads = ids
    for k, (table, columns) in enumerate(((counts, _NUMBERS[:4]), (illegal, ("illegal",)), (edits, ("cost", "audit")))):
        named = table.withColumnRenamed("conv_id", f"c{k}")
        heads = heads.join(named, F.col("conv_id").eqNullSafe(F.col(f"c{k}")), "left").drop(f"c{k}")
    heads = heads.select("conv_id", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in _NUMBERS), F.coalesce("audit", F.lit("")).alias("audit"))
    return repaired_hashes(heads, rows)
