"""Packing examples into training sequences: vector bin packing.

An example has a size in several dimensions (tokens, segments, loss-bearing
tokens), and a sequence a limit in each. The dot-product heuristic fills one
sequence after another: of the examples that fit what is left in every
dimension, it takes the one whose sizes, each as a share of its limit, have the
largest dot product with the shares that are left.

Documents are cut where a sequence ends: all pieces but a document's last fill
a sequence; the last ones are packed. Only piece metadata is shuffled, never
text or ids, and a task packs bounded windows of pieces.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from functools import partial
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import prepare, stored, table

MAX_TOKENS, MAX_SEGMENTS = 1024, 128
#: The examples that are packed together.
WINDOW = 32_768
LIMITS = {"tokens": MAX_TOKENS, "segments": MAX_SEGMENTS, "loss_tokens": MAX_TOKENS}


#: The pattern by which a byte-level pre-tokenizer cuts text, as its file names no other.
BYTE_LEVEL_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Texts with a run of so many white-space characters take the library: the pattern backtracks over a run, and tiktoken panics on about a million.
LONG_SPACE = 10_000
_LONG_SPACE = re.compile(rf"\s{{{LONG_SPACE}}}")


def _has_long_space(text: str) -> bool:
    """A run of LONG_SPACE covers one of every LONG_SPACE places, so most texts are settled by a look at those."""
    return any(c.isspace() for c in text[LONG_SPACE - 1 :: LONG_SPACE]) and _LONG_SPACE.search(text) is not None


def _byte_of() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable ones for themselves, the rest for 256 and on, in order."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


def _ranked(path: str):
    """The file's vocabulary as an encoder by ranks, or None where the file isn't a plain byte-level BPE whose ids follow its merges."""
    import tiktoken

    spec = json.loads(Path(path).read_text(encoding="utf-8"))
    pre, model, special = spec.get("pre_tokenizer") or {}, spec["model"], {t["content"] for t in spec.get("added_tokens", [])}
    plain = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not spec.get("normalizer")
    if not plain or model.get("type") != "BPE" or any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")):
        return None
    merged = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
    if [model["vocab"].get(m) for m in merged] != list(range(256, 256 + len(merged))):
        return None
    byte = _byte_of()
    ranks = {bytes(byte[c] for c in token): i for token, i in model["vocab"].items() if token not in special}
    return tiktoken.Encoding("by-ranks", pat_str=BYTE_LEVEL_PATTERN, mergeable_ranks=ranks, special_tokens={})


class Encoder:
    """Ids of whole texts by a file of the `tokenizers` library.

    A plain byte-level BPE is run by its ranks, which gives the same ids in a
    fifth of the time (tested on every code point and on the tables' texts).
    Other files, and texts with a special token's string or a run of LONG_SPACE
    white-space characters, take the library.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model, self.ranked = Tokenizer.from_file(path), _ranked(path)
        self.special = [t.content for t in self.model.get_added_tokens_decoder().values()]

    def ids(self, text: str) -> bytes:
        """Unsigned little-endian 32-bit ids."""
        if self.ranked is None or any(s in text for s in self.special) or _has_long_space(text):
            found = self.model.encode(text, add_special_tokens=False).ids
        else:
            found = self.ranked.encode_ordinary(text)
        return np.array(found, "<u4").tobytes()


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _pieces(batches, path: str, limit: int, end: int):
    encode, last = encoder(path).ids, int(end).to_bytes(4, "little")
    for b in batches:
        out = []
        for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            ids = memoryview(encode(text.as_py() or "") + last)
            n = len(ids) // 4
            out += [(doc, i, min(limit, n - i), zlib.crc32(ids[4 * i : 4 * (i + limit)]), n) for i in range(0, n, limit)]
        cols = list(zip(*out, strict=True)) if out else [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])


def pieces(docs: DataFrame, tokenizer: str, limit: int = MAX_TOKENS, end_id: int = 0) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens): the ids of each whole text and end_id, cut at every limit ids. Null is the empty text, whose one piece is end_id."""
    prepare(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(partial(_pieces, path=tokenizer, limit=limit, end=end_id), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def fill(sizes: np.ndarray, limits: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """A bin and a place in it for each example (a row of sizes), and the number of bins. Examples of equal sizes are one kind; ties go to the larger first size, then to the earlier example."""
    kinds, kind, count = np.unique(-sizes, axis=0, return_inverse=True, return_counts=True)
    kinds, kind = -kinds, kind.ravel()
    members = np.argsort(kind, kind="stable")
    following = np.concatenate(([0], np.cumsum(count)))[:-1]
    share = kinds / limits
    bin_of, place = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    bins, left = 0, len(sizes)
    while left:
        room, at = limits.copy(), 0
        while left:
            score = np.where((count > 0) & (kinds <= room).all(axis=1), share @ (room / limits), -1.0)
            k = int(score.argmax())
            if score[k] < 0:
                break
            i = members[following[k]]
            bin_of[i], place[i] = bins, at
            room, at = room - kinds[k], at + 1
            following[k] += 1
            count[k] -= 1
            left -= 1
        if not at:
            raise ValueError("an example exceeds a limit by itself")
        bins += 1
    return bin_of, place, bins


def _pack(batches, columns: list[str], limits: list[int], window: int):
    from pyspark import TaskContext

    base, held = TaskContext.get().partitionId() << 40, []

    def flush():
        nonlocal base, held
        t = pa.Table.from_batches(held).combine_chunks()
        held = []
        sizes = np.stack([t.column(c).to_numpy() for c in columns], axis=1).astype(np.int64)
        alone = sizes[:, 0] >= limits[0]  # full already
        seq, place = np.empty(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
        seq[alone] = np.arange(alone.sum())
        if not alone.all():
            seq[~alone], place[~alone], more = fill(sizes[~alone], np.array(limits))
            seq[~alone] += alone.sum()
        else:
            more = 0
        order = np.lexsort((place, seq))
        ends = np.cumsum(sizes[order, 0])
        first = np.concatenate(([True], np.diff(seq[order]) != 0))
        before = ends - sizes[order, 0]
        offset = np.empty(len(sizes), np.int64)
        offset[order] = before - np.repeat(before[first], np.diff(np.concatenate((np.flatnonzero(first), [len(seq)]))))
        t = t.append_column("sequence_id", pa.array(seq + base)).append_column("offset", pa.array(offset))
        base += int(alone.sum()) + more
        return t.to_batches()

    for b in batches:
        held.append(b)
        if sum(x.num_rows for x in held) >= window:
            yield from flush()
    if sum(x.num_rows for x in held):
        yield from flush()


def pack(examples: DataFrame, key: str | list[str], limits: dict[str, int] | None = None, window: int = WINDOW) -> DataFrame:
    """examples with sequence_id and offset: each example whole in one sequence, within every limit.

    limits names the size columns, tokens first; offsets count that one. Sizes
    can't be null. Examples are dealt by key (even: no group stands behind it)
    into tasks of about window rows, so a longer input gets more tasks, not
    larger ones; a task sorts its rows, so one that is run again for a lost
    executor packs them alike. An example that alone exceeds a limit is an
    error. An empty input packs to nothing.
    """
    prepare(examples.sparkSession)
    limits = limits or LIMITS
    n = examples.count()
    schema = examples.schema.add("sequence_id", "long").add("offset", "long")
    keys = [key] if isinstance(key, str) else key
    dealt = examples.repartition(max(1, -(-n // window)), *keys).sortWithinPartitions(*keys, *limits)
    return dealt.mapInArrow(partial(_pack, columns=list(limits), limits=list(limits.values()), window=window), schema)


def pack_documents(docs: DataFrame, tokenizer: str | None = None, max_segments: int = MAX_SEGMENTS) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) per piece of each row of docs. All ids bear loss. Rows that repeat a doc_id, or have none, are packed like others; extra columns are ignored."""
    cut = stored(pieces(docs, tokenizer or default_tokenizer()), "pieces")
    sized = cut.withColumns({"tokens": F.col("length"), "segments": F.lit(1).cast("long"), "loss_tokens": F.col("length")})
    # By piece, not by document: rows without a doc_id, or one long text, are dealt over all tasks.
    packed = pack(sized, ["doc_id", "start", "ids_crc32"], LIMITS | {"segments": max_segments})
    return packed.drop("tokens", "segments", "loss_tokens")


def _turn_tokens(batches, path: str):
    ids = encoder(path).ids
    for b in batches:
        counts = [len(ids(t.as_py() or "")) // 4 + 1 for t in b.column(2)]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(counts, pa.int64())], names=["conv_id", "role", "tokens"])


def conversation_sizes(turns: DataFrame, tokenizer: str | None = None, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """(conv_id, tokens, segments, loss_tokens) of each conversation of turns (conv_id, role, text): a turn is a segment of its text's ids and an end id, and bears loss where one of loss_roles speaks. Null text is empty; turns without a conv_id are one conversation."""
    prepare(turns.sparkSession)
    rows = turns.select(F.col("conv_id").cast("string").alias("conv_id"), F.col("role").cast("string").alias("role"), "text")
    counted = rows.mapInArrow(partial(_turn_tokens, path=tokenizer or default_tokenizer()), "conv_id string, role string, tokens long")
    loss = F.coalesce(F.col("role").isin(*loss_roles), F.lit(False))
    return counted.groupBy("conv_id").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("segments"), F.sum(F.when(loss, F.col("tokens")).otherwise(0)).alias("loss_tokens"))


def pack_conversations(turns: DataFrame, limits: dict[str, int] | None = None, tokenizer: str | None = None, window: int = WINDOW) -> DataFrame:
    """conversation_sizes() with sequence_id and offset: whole conversations under all three limits at once. One that exceeds a limit by itself has a null sequence_id and offset."""
    limits = limits or LIMITS | {"loss_tokens": MAX_TOKENS // 2}
    sized = stored(conversation_sizes(turns, tokenizer), "conversation-sizes")
    fits = F.lit(True)
    for c, most in limits.items():
        fits = fits & (F.col(c) <= most)
    packed = pack(sized.where(fits), "conv_id", limits, window)
    none = F.lit(None).cast("long")
    return packed.unionByName(sized.where(~fits).withColumns({"sequence_id": none, "offset": none}))


def query(spark, sf_dir):
    return pack_documents(table(spark, sf_dir, "documents"))


def conversations_query(spark, sf_dir):
    """All conversations, packed under limits on tokens, turns and loss-bearing tokens at once."""
    return pack_conversations(table(spark, sf_dir, "conversations"))
