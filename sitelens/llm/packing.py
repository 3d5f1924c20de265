"""Filling fixed-capacity containers: vector bin packing with the dot-product heuristic.

Method
------
Each text is an item with three demands: tokens, one segment, loss-bearing tokens. As in
instruction data the opening of a text (its heading, or else its first sentence) is the
prompt, which bears no loss; the rest is the answer, which does. A text longer than the
capacity is cut into full containers, and its rest is an item; no other text is split. A
container is filled step by step with the item whose demand has the largest dot product with
the room that is left, among the items that fit in all three dimensions. Items of equal
demands form one class, so a step looks at classes, not items.

The limits: ``CAPACITY`` tokens, ``SEGMENTS`` texts, and ``MOST_LOSS`` loss-bearing tokens, two
below the capacity for each segment (its beginning and its end). An item that exceeds the limit
of loss by itself, which mustn't be split for that, has a container of its own.

Scale: texts are tokenised where they are read and never shuffled; items (a few numbers)
are spread by hash over groups of a bounded size, and each group is packed by one task. A
group leaves at most a few containers underfull.

Defined cases: null and blank texts are no items; a text of exactly the capacity fills one
container; repeated texts and repeated rows are items of their own; an empty table gives no
rows; long texts are cut at token borders, given as token offsets; the number of a container
is unique whatever their number (group and place, or row and part).
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelens.session import spread, stored

#: Where the public tokenizer's ranks lie on every machine, and the pattern that goes with them (fixed value).
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CAPACITY, SEGMENTS = 512, 8
MOST_LOSS = CAPACITY - 2 * SEGMENTS
GROUP_ITEMS = 20_000
_PROMPT = regex.compile(r"\s*+[^\n.!?。！？।؟]*+[\n.!?。！？।؟]?")
_BLANK = regex.compile(r"[\s\p{Z}\p{Cf}\p{Cc}]*")
_encoders: dict[str, object] = {}


def encoder(vocabulary: str):
    """The tokenizer of a rank file, loaded once for each worker."""
    if vocabulary not in _encoders:
        import tiktoken

        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encoders[vocabulary] = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[vocabulary]


def is_blank(text: str | None) -> bool:
    return not text or _BLANK.fullmatch(text) is not None


def _sizes(key: str, vocabulary: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for b in batches:
            rows = [(k, t) for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if not is_blank(t)]
            tokens = [len(x) for x in enc.encode_ordinary_batch([t for _, t in rows], num_threads=1)]
            prompt = [len(x) for x in enc.encode_ordinary_batch([_PROMPT.match(t).group() for _, t in rows], num_threads=1)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([k for k, _ in rows], b.schema.field(0).type), pa.array(tokens, pa.int32()), pa.array([min(n, p) for n, p in zip(tokens, prompt)], pa.int32())], names=[key, "all", "prompt"]
            )

    return run


def pack(tokens: np.ndarray, loss: np.ndarray, capacity: int, segments: int, most_loss: int) -> np.ndarray:
    """The container number of each item of one group."""
    classes, which, left = np.unique(np.stack([tokens, loss], 1), axis=0, return_inverse=True, return_counts=True)
    order = np.argsort(which.ravel(), kind="stable")
    first = np.concatenate(([0], np.cumsum(left)[:-1]))
    demand = np.stack([classes[:, 0] / capacity, np.full(len(classes), 1 / segments), classes[:, 1] / most_loss], 1)
    out, bin_no, alive = np.empty(len(tokens), np.int64), 0, len(tokens)
    need, need_loss, left, taken = classes[:, 0], classes[:, 1], left.copy(), np.zeros(len(classes), int)
    while alive:
        room, seats, room_loss, level = capacity, segments, most_loss, len(classes)
        while seats and alive:
            top = int(np.searchsorted(need[:level], room, "right"))  # classes are sorted by tokens
            fits = (left[:top] > 0) & (need_loss[:top] <= room_loss)
            if not fits.any():
                break
            score = demand[:top] @ np.array([room / capacity, seats / segments, room_loss / most_loss])
            best = int(np.where(fits, score, -1.0).argmax())
            out[order[first[best] + taken[best]]] = bin_no
            taken[best] += 1
            left[best] -= 1
            alive -= 1
            room, seats, room_loss = room - int(need[best]), seats - 1, room_loss - int(need_loss[best])
            if room == 0:
                break
        bin_no += 1
        if bin_no % 256 == 0:  # used-up classes leave the search
            keep = left > 0
            need, need_loss, demand, left, first, taken = need[keep], need_loss[keep], demand[keep], left[keep], first[keep], taken[keep]
            classes = classes[keep]
    return out


def _packer(key: str, capacity: int, segments: int, most_loss: int):
    def run(group: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        order = np.lexsort((t.column("row").to_numpy(), t.column("part").to_numpy(), t.column(key).to_numpy()))  # the same result in every run
        t = t.take(pa.array(order))
        no = pack(t.column("tokens").to_numpy(), t.column("loss").to_numpy(), capacity, segments, most_loss)
        return t.drop_columns(["grp", "row"]).append_column("container", pa.array([f"g{group[0].as_py()}.{n}" for n in no], pa.string()))

    return run


def fill_containers(df: DataFrame, key: str, text: str, capacity: int = CAPACITY, segments: int = SEGMENTS, most_loss: int | None = None, vocabulary: str = VOCABULARY, group_items: int = GROUP_ITEMS) -> DataFrame:
    """(``key``, part, from_token, tokens, loss, container) for each item; ``part`` counts the
    pieces of a text that alone exceeds the capacity, from 0."""
    most_loss = most_loss or max(1, capacity - 2 * segments)
    kind = df.select(key).schema[0].dataType.simpleString()
    sized = spread(df.select(key, text)).mapInArrow(_sizes(key, vocabulary), f"{key} {kind}, all int, prompt int").withColumn("row", F.monotonically_increasing_id())
    last = F.when(F.col("all") > capacity, F.floor((F.col("all") - 1) / capacity)).otherwise(F.lit(0)).cast("int")
    parts = sized.select("*", F.explode(F.sequence(F.lit(0), last)).alias("part")).withColumn("from_token", F.col("part") * capacity)
    items = parts.withColumn("tokens", F.least(F.col("all") - F.col("from_token"), F.lit(capacity)))
    bare = F.greatest(F.lit(0), F.least(F.col("prompt") - F.col("from_token"), F.col("tokens")))
    items = stored(items.select(key, "row", "part", "from_token", "tokens", (F.col("tokens") - bare).alias("loss")), "items")
    groups = max(1, -(-items.count() // group_items))
    alone = (F.col("tokens") == capacity) | (F.col("loss") > most_loss)
    single = items.where(alone).withColumn("container", F.concat(F.lit("r"), F.col("row").cast("string"), F.lit("."), F.col("part").cast("string"))).drop("row")
    rest = items.where(~alone).withColumn("grp", F.pmod(F.xxhash64(key, "part", "row"), F.lit(groups)))
    schema = f"{key} {kind}, part int, from_token int, tokens int, loss int, container string"
    return rest.groupBy("grp").applyInArrow(_packer(key, capacity, segments, most_loss), schema).unionByName(single)
