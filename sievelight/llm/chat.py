"""4. Chat formatting in budgeted windows.

Prefix sums of turn tokens choose the spans greedily: a window takes whole turns from its first one on while their sum fits
its room, and the next window begins with the turn that doesn't fit. Where a window begins depends on the one before it,
so the line of all turns is cut into segments: each tells, for the few turns at which a window can enter it, where the
window that leaves it begins and ends; the driver links those (at most `SEGMENTS` segments, room / tokens of a turn rows
of each that lies within one conversation), and each segment then marks its windows. A conversation of any length is
dealt over many tasks.

Each window starts with the conversation's system turn, then repeats the turns that begin within the last `history`
tokens before it; the loss mask covers the texts of assistant turns that are new in the window, so each is a target once.
The room is the budget less the system turn and the history, half of what the system turn leaves at least; the history
gives way where the new turns leave less. So a window exceeds the budget only if the system turn and one single new turn
already do.

Template: `<|im_start|>role\\n`, text, `<|im_end|>\\n`; tokens are counted on it. In texts and roles a backslash is put
between `<` and `|`, and one more where some are already; roles also escape newlines. The reader undoes this exactly.

Defined cases: a null text or role is empty; a null conversation id is a conversation of its own, apart from any string;
null turns come first, equal turns in the order of role and text; equal rows are kept; the system turn is the first row
with role `system`; no rows, no windows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import join_unique, prefix_sums, store
from .tokens import DEFAULT_FILE, encoder

START, END = "<|im_start|>", "<|im_end|>\n"
#: The line of turns is cut into so many segments at most, of SEGMENT turns at least.
SEGMENTS, SEGMENT = 1 << 14, 1 << 10


def escape(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\1\\|", text)


def unescape(text: str) -> str:
    return re.sub(r"<(\\*)\\\|", r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def opening(role: str) -> str:
    return f"{START}{escape_role(role)}\n"


def render(turns: list[dict]) -> tuple[str, list[dict]]:
    """The text and the spans of the loss mask, in characters."""
    out, mask, at = [], [], 0
    for t in turns:
        head, text = opening(t["role"]), escape(t["text"])
        at += len(head)
        if t["role"] == "assistant" and not t["repeated"] and text:
            mask.append({"start": at, "end": at + len(text)})
        at += len(text) + len(END)
        out += [head, text, END]
    return "".join(out), mask


def parse(text: str) -> list[tuple[str, str]]:
    """(role, text) of all turns of a rendered window."""
    return [(unescape_role(r), unescape(t)) for r, t in re.findall(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", text, re.S)]


def _token_counts(turns: DataFrame, tokenizer: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = [opening(r) + escape(t) + END for r, t in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            _, at = encoder(tokenizer).encode_column(pa.array(whole, pa.string()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at[1:] - at[:-1])], names=["conv", "turn", "role", "text", "tokens"])

    kinds = [f"{c} {t}" for c, t in turns.dtypes]
    return turns.mapInArrow(run, ", ".join([*kinds, "tokens long"]))


class _Segment:
    """A run of turns in order. Each row: rank, before (tokens before it on the whole line), tokens, base (before of its conversation's first turn), room."""

    def __init__(self, rows: np.ndarray):
        self.rank, self.before, tokens, base, room = rows
        self.end = self.before + tokens
        n = len(self.rank)
        self.first = np.flatnonzero(self.before == base)  # where conversations begin
        closes = np.append(self.first, n)
        self.limit = np.maximum(self.end, self.before + room)  # of a window that begins here: the next one begins with the first turn that ends beyond
        self.next = np.minimum(np.searchsorted(self.end, self.limit, "right"), closes[np.searchsorted(self.first, np.arange(n), "right")]).tolist()
        self.entries = 0 if len(self.first) else max(1, int(np.searchsorted(self.before, self.before[0] + room[0])))

    def last(self, start: int) -> int:
        """Where the window that leaves the segment begins, if one begins at start."""
        while self.next[start] < len(self.next):
            start = self.next[start]
        return start

    def exits(self) -> list[tuple[int, int, int, int]]:
        """(end of the entering turn or -1 for any, limit, rank and before of the window that leaves)."""
        from_ = [(-1, self.first[-1])] if len(self.first) else [(self.end[k], k) for k in range(self.entries)]
        return [(int(e), int(self.limit[k]), int(self.rank[k]), int(self.before[k])) for e, k in ((e, self.last(int(k))) for e, k in from_)]

    def windows(self, entered: tuple[int, int, int] | None) -> tuple[np.ndarray, np.ndarray]:
        """rank and before of the first turn of each turn's window; entered: limit, rank and before of the window that was open."""
        n, marks = len(self.rank), np.zeros(len(self.rank), bool)
        starts = self.first.tolist()
        if entered is not None:
            k = int(np.searchsorted(self.end, entered[0], "right"))
            starts.append(k if not starts or k < starts[0] else n)
        for k in starts:
            stop = n if not len(self.first) else int(np.append(self.first, n)[np.searchsorted(self.first, k, "right")])
            while k < stop:
                marks[k] = True
                k = self.next[k]
        place = np.maximum.accumulate(np.where(marks, np.arange(n), -1))
        open_ = entered or (0, 0, 0)
        return np.where(place < 0, open_[1], self.rank[place]), np.where(place < 0, open_[2], self.before[place])


_FIELDS = ["rank", "before", "tokens", "base", "room"]


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, _Segment]]:
    """Segments from sorted rows of the columns seg and _FIELDS."""
    seg, held = None, []
    for batch in batches:
        rows = np.stack([c.to_numpy() for c in batch.columns])
        for part in np.split(rows, np.flatnonzero(np.diff(rows[0])) + 1, axis=1) if rows.shape[1] else ():
            if held and seg != part[0, 0]:
                yield seg, _Segment(np.concatenate(held, 1))
                held = []
            seg = int(part[0, 0])
            held.append(part[1:])
    if held:
        yield seg, _Segment(np.concatenate(held, 1))


def _spans(line: DataFrame, segment: int) -> DataFrame:
    """line (of _FIELDS) with wrank and wbefore, those of the first turn of the row's window."""
    dealt = line.select(F.expr(f"rank div {segment}").alias("seg"), *_FIELDS).repartition("seg").sortWithinPartitions("rank")

    def leave(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for seg, s in _segments(batches):
            rows = [(seg, *x) for x in s.exits()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["seg", "end", "limit", "rank", "before"])

    entered: dict[int, tuple[int, int, int]] = {}
    carry, done = None, -1
    for r in dealt.mapInArrow(leave, "seg long, end long, limit long, rank long, before long").orderBy("seg", "end").collect():
        if done != r.seg:
            if carry is not None:
                entered[r.seg] = carry
            done, found = r.seg, False
        if not found and (r.end < 0 or carry is not None and r.end > entered[r.seg][0]):
            carry, found = (r.limit, r.rank, r.before), True
    shared = line.sparkSession.sparkContext.broadcast(entered)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for seg, s in _segments(batches):
            wrank, wbefore = s.windows(shared.value.get(seg))
            yield pa.RecordBatch.from_arrays([pa.array(s.rank), pa.array(s.before), pa.array(s.end - s.before), pa.array(wrank), pa.array(wbefore)], names=["rank", "before", "tokens", "wrank", "wbefore"])

    return store(dealt.mapInArrow(mark, "rank long, before long, tokens long, wrank long, wbefore long"), "spans")


def windows(conversations: DataFrame, *, budget: int = 1024, history: int = 256, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", tokenizer: str = DEFAULT_FILE, segment: int = SEGMENT) -> DataFrame:
    """Per window: conv, window (number of its first new turn in the conversation), n_repeated (its first turns, seen before), n_new, tokens, text, mask array<struct<start, end>>."""
    turns = conversations.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.coalesce(role_col, F.lit("")).alias("role"), F.coalesce(text_col, F.lit("")).alias("text"))
    counted = store(_token_counts(turns, tokenizer), "turns")
    order = [F.col("conv"), F.col("turn"), F.col("role"), F.col("text")]
    key = F.when(F.col("conv").isNull(), "n").otherwise(F.concat(F.lit("v"), F.col("conv").cast("string")))
    line = prefix_sums(counted, order, {"before": F.col("tokens"), "rank": F.lit(1)}, "chat").withColumn("key", key)
    own = F.when(F.col("role") == "system", F.struct("rank", "before", "tokens", "text"))
    heads = store(line.groupBy("key").agg(F.min("before").alias("base"), F.min("rank").alias("base_rank"), F.count("*").alias("rows"), F.min(own).alias("sys")), "heads")
    left = F.lit(budget) - F.coalesce("sys.tokens", F.lit(0))
    room = F.greatest(left - history, F.floor(left / 2), F.lit(1)).cast("long")
    slim = line.select("key", "rank", "before", "tokens")
    placed = store(join_unique(slim, heads.select("key", "base", "rows", room.alias("room")), "key", "rows"), "placed")
    rows = heads.agg(F.sum("rows")).first()[0] or 0
    spans = _spans(placed, max(segment, -(-rows // SEGMENTS)))

    # how far back each window repeats; no key of these joins is a conversation
    made = spans.groupBy("wrank", "wbefore").agg(F.sum("tokens").alias("n_tokens"), F.max("rank").alias("last"))
    made = made.join(placed.select(F.col("rank").alias("wrank"), "key"), "wrank")
    made = join_unique(made, heads.select("key", "base", "base_rank", "sys", "rows"), "key", "rows")
    again = F.coalesce(F.col("sys.rank") < F.col("wrank"), F.lit(False))
    spare = F.lit(budget) - F.col("n_tokens") - F.when(again, F.col("sys.tokens")).otherwise(0)
    since = F.greatest(F.col("base"), F.col("wbefore") - F.greatest(F.lit(0), F.least(F.lit(history), spare)))
    made = store(made.select("wrank", "wbefore", "base_rank", F.when(again, F.col("sys")).alias("sys"), F.col("sys.rank").alias("sys_rank"), since.alias("since")), "windows")
    back = made.where("since < wbefore").withColumn("cell", F.explode(F.expr(f"sequence(since div {history}, (wbefore - 1) div {history})"))) if history else made.limit(0).withColumn("cell", F.lit(0))
    turn_cells = spans.select("rank", "before", F.expr(f"before div {max(1, history)}").alias("cell"))
    old = back.join(turn_cells, "cell").where("before >= since and before < wbefore and (sys_rank is null or rank <> sys_rank)").select("rank", "wrank", F.lit(False).alias("new"))
    members = old.unionByName(spans.select("rank", "wrank", F.lit(True).alias("new")))
    texts = line.select("rank", "conv", "role", "text", "tokens").join(members, "rank")
    listed = texts.groupBy("wrank").agg(F.first("conv").alias("conv"), F.array_sort(F.collect_list(F.struct("rank", "role", "text", "tokens", "new"))).alias("turns"))
    none = F.array().cast("array<struct<rank:bigint,role:string,text:string,tokens:bigint,new:boolean>>")
    system = F.when(F.col("sys").isNotNull(), F.array(F.struct("sys.rank", F.lit("system").alias("role"), "sys.text", "sys.tokens", F.lit(False).alias("new")))).otherwise(none)
    made = listed.join(made.select("wrank", "base_rank", "sys"), "wrank").select(
        "conv", (F.col("wrank") - F.col("base_rank")).alias("window"), F.concat(system, F.filter("turns", lambda t: ~t.new)).alias("old"), F.filter("turns", lambda t: t.new).alias("new")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            out = []
            for r in rows:
                text, mask = render([t | {"repeated": True} for t in r["old"]] + [t | {"repeated": False} for t in r["new"]])
                out.append((len(r["old"]), len(r["new"]), sum(t["tokens"] for t in r["old"] + r["new"]), text, mask))
            cols = list(zip(*out, strict=True)) if out else [()] * 5
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True))], names=["conv", "window", "n_repeated", "n_new", "tokens", "text", "mask"])

    kind = counted.schema["conv"].dataType.simpleString()
    return made.mapInArrow(run, f"conv {kind}, window long, n_repeated long, n_new long, tokens long, text string, mask array<struct<start: bigint, end: bigint>>")


def read_back(formatted: DataFrame) -> DataFrame:
    """Per conversation, from the formatted windows alone: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    A digest over a conversation is sequential; its windows pass through one task in order, one batch at a time.
    """
    kind = formatted.schema["conv"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: list | None = None

        def row() -> dict:
            conv, n, turns, chars, loss, total = state
            return {"conv": conv, "n_turns": n, "turns_sha256": turns.hexdigest(), "loss_chars": chars, "loss_sha256": loss.hexdigest(), "formatted_chars": total}

        for batch in batches:
            done = []
            for r in batch.to_pylist():
                if state is None or state[0] != r["conv"]:
                    if state is not None:
                        done.append(row())
                    state = [r["conv"], 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text in parse(r["text"])[r["n_repeated"] :]:
                    state[1] += 1
                    state[2].update(f"{role}\n{text}\n".encode())
                for m in r["mask"]:
                    target = unescape(r["text"][m["start"] : m["end"]])
                    state[3] += len(target)
                    state[4].update(target.encode())
                state[5] += len(r["text"])
            yield pa.RecordBatch.from_pylist(done, schema)
        if state is not None:
            yield pa.RecordBatch.from_pylist([row()], schema)

    from pyspark.sql.pandas.types import to_arrow_type

    schema = pa.schema([("conv", to_arrow_type(formatted.schema["conv"].dataType)), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
    ordered = formatted.select("conv", "window", "n_repeated", "text", "mask").repartition("conv").sortWithinPartitions("conv", "window")
    return ordered.mapInArrow(run, f"conv {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
