"""Removal of repeated byte passages across all documents, by suffix arrays.

Every window of ``length`` bytes has an anchor: its ``gram``-byte piece with the smallest hash, the
leftmost one of equals.  Equal windows have equal anchors at equal places.  Neighbouring windows
with one anchor form a segment, so a text gives about one segment per ``length / 3`` bytes.

1. Anchors that occur twice are counted out with map-side sums; the others need no more work.
2. Equal segments are reduced to the first; in all later ones every window repeats.
3. Different segments around one anchor meet in a task, which builds a suffix array of their bytes
   by two-stage sorting.  Sorted neighbours with ``length`` common bytes are equal windows, and all
   but the first of them repeat.  Anchors with very many different segments are compared window by
   window, with map-side minima, so no task holds an unbounded group.
4. The spans of a document meet its text, are united and cut out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import new_path, ship
from .common import Spans, Texts, slices
from .suffix_sort import common_prefixes, suffix_array

LENGTH = 100
GRAM = 32
#: Bytes that one suffix array holds, and different segments per anchor that may go into it.
ARRAY_BYTES = 1 << 20
MAX_SEGMENTS = 4096


def _stored(df: DataFrame, label: str) -> DataFrame:
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _windows(texts: Texts, length: int, gram: int):
    """Hashes of any spans, first places, lengths in windows and anchor hashes of the segments."""
    data, n = texts.data, len(texts.data)
    spans = Spans(data)
    hashes = spans.sliding(gram)
    # smallest hash first, then the leftmost place; both fit into one number
    least = (hashes & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(hashes), dtype=np.uint64)
    width, grams = 1, length - gram + 1
    while 2 * width <= grams and len(least) > width:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if grams > width and len(least) > grams - width:
        least = np.minimum(least[: width - grams], least[grams - width :])
    ends = np.repeat(texts.borders[1:], np.diff(texts.borders))
    windows = np.flatnonzero(np.arange(n) + length <= ends)
    anchors = (least[windows] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    new = np.append(True, (anchors[1:] != anchors[:-1]) | (windows[1:] != windows[:-1] + 1))
    if not len(windows):
        new = np.zeros(0, bool)
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(windows)))
    begins = windows[first]
    anchor = hashes[anchors[first]] if len(first) else np.zeros(0, np.uint64)
    return spans, begins, count, anchor


def anchor_counts(docs: DataFrame, id_col: str, text_col: str, length: int, gram: int) -> DataFrame:
    """(anchor, n): segments per anchor, already added up over the texts of a slice.

    Neither the segments' own hashes nor their documents are needed to find the anchors that occur twice.
    """
    ship(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(0)):
                anchor, n = np.unique(_windows(Texts(batch.column(0).slice(a, b - a)), length, gram)[3], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(n)], names=["anchor", "n"])

    texts = _keyed(docs, id_col, text_col).select("text")
    return texts.mapInArrow(count, "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n"))


def segments(docs: DataFrame, id_col: str, text_col: str, length: int, gram: int) -> DataFrame:
    """(d, t, start, n, anchor, seg): document, first window, windows, hashes of anchor and bytes."""
    ship(docs.sparkSession)
    id_type = docs.schema[id_col].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(2)):
                part = batch.slice(a, b - a)
                texts = Texts(part.column(2))
                spans, begins, count, anchor = _windows(texts, length, gram)
                whole = spans.hash(begins, begins + count + length - 1)
                doc = np.searchsorted(texts.borders, begins, "right") - 1
                start, at = begins - texts.borders[doc], pa.array(doc)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(at), part.column(1).take(at),
                        pa.array(start.astype(np.int32)), pa.array(count.astype(np.int32)),
                        pa.array(anchor.view(np.int64)), pa.array(whole.view(np.int64)),
                    ],
                    names=["d", "t", "start", "n", "anchor", "seg"],
                )

    return _keyed(docs, id_col, text_col).mapInArrow(
        cut, f"d {id_type}, t int, start int, n int, anchor long, seg long"
    )


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Id, a hash that tells texts with the same id apart, and the text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("d"), F.hash(text).alias("t"), text.alias("text"))


def _same_document():
    return F.col("d").eqNullSafe(F.col("_d")) & (F.col("t") == F.col("_t"))


def _pieces(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Bytes of the wanted segments; rows are d, t, text and a list of (anchor, start, n, crowded)."""
    for batch in batches:
        for a, b in slices(batch.column(2)):
            part = batch.slice(a, b - a)
            texts = Texts(part.column(2))
            lists = part.column(3)
            row = np.repeat(np.arange(part.num_rows), pa.compute.list_value_length(lists).to_numpy(False))
            anchor, start, n, crowded = lists.flatten().flatten()
            first = texts.borders[row] + start.to_numpy()
            last = first + n.to_numpy() + length - 1
            raw = texts.data.tobytes()
            at = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0).take(at), part.column(1).take(at), start.cast(pa.int64()), anchor,
                    crowded, pa.array([raw[x:y] for x, y in zip(first.tolist(), last.tolist())], pa.binary()),
                ],
                names=["d", "t", "start", "anchor", "crowded", "bytes"],
            )


def _single_windows(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """One row with a hash for each window of the segments."""
    for batch in batches:
        texts = Texts(batch.column(4))
        n = np.maximum(np.diff(texts.borders) - length + 1, 0)
        row = np.repeat(np.arange(texts.n), n)
        shift = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        first = texts.borders[row] + shift
        at = pa.array(row)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0).take(at), batch.column(1).take(at),
                pa.array(batch.column(2).to_numpy()[row] + shift), batch.column(3).take(at),
                pa.array(Spans(texts.data).hash(first, first + length).view(np.int64)),
            ],
            names=["d", "t", "start", "anchor", "window"],
        )


def _doc_rank(d: pa.Array, t: pa.Array) -> np.ndarray:
    """Order of documents: by id (null first), then by the hash of the text."""
    pairs = pa.table({"d": d, "t": t})
    order = pa.compute.sort_indices(
        pairs, sort_keys=[("d", "ascending"), ("t", "ascending")], null_placement="at_start"
    )
    codes = [pa.compute.fill_null(c.dictionary_encode().indices, -1).to_numpy(False)
             for c in (d.take(order), t.take(order))]
    new = np.append(False, (np.diff(codes[0]) != 0) | (np.diff(codes[1]) != 0))
    rank = np.empty(len(d), np.int64)
    rank[order.to_numpy()] = np.cumsum(new)
    return rank


def later_windows(text: np.ndarray, begins: np.ndarray, doc: np.ndarray, start: np.ndarray, length: int):
    """(segment, place in it) of windows that equal a window of an earlier document or place.

    ``text`` holds the segments one after another, ``begins`` their borders.
    """
    order = suffix_array(text, length)
    segment = np.searchsorted(begins, order, "right") - 1
    inside = order + length <= begins[segment + 1]
    order, segment = order[inside], segment[inside]
    common = common_prefixes(order, text, length)
    group = np.cumsum(common < length)
    place = order - begins[segment]
    begin, owner = start[segment] + place, doc[segment]
    inner = np.lexsort((begin, owner, group))
    new = np.append(True, np.diff(group[inner]) != 0)[: len(inner)]
    first = inner[np.flatnonzero(new)[np.cumsum(new) - 1]]  # a row may be there twice
    chosen = inner[(begin[inner] != begin[first]) | (owner[inner] != owner[first])]
    return segment[chosen], place[chosen]


def _compare(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Repeated spans among segments that come sorted by anchor."""
    held: list[pa.RecordBatch] = []
    size = 0

    def spans(rows: pa.Table) -> pa.RecordBatch:
        rows = rows.combine_chunks()
        column = {c: rows.column(c).chunk(0) for c in rows.column_names}
        texts = Texts(column["bytes"])
        doc = _doc_rank(column["d"], column["t"])
        start = column["start"].to_numpy().astype(np.int64)
        segment, place = later_windows(texts.data, texts.borders, doc, start, length)
        order = np.lexsort((place, segment))
        segment, place = segment[order], place[order]
        new = np.append(True, (np.diff(segment) != 0) | (np.diff(place) != 1))[: len(segment)]
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(segment)) - 1
        at = pa.array(segment[first])
        begin = start[segment[first]] + place[first]
        end = begin + place[last] - place[first] + length if len(first) else begin
        return pa.RecordBatch.from_arrays(
            [column["d"].take(at), column["t"].take(at), pa.array(begin), pa.array(end)],
            names=["d", "t", "from", "to"],
        )

    for batch in batches:
        while batch.num_rows:
            sizes = pa.compute.binary_length(batch.column("bytes")).to_numpy()
            fits = int(np.searchsorted(np.cumsum(sizes), ARRAY_BYTES - size, "right"))
            fits = min(batch.num_rows, max(fits, 1))
            held.append(batch.slice(0, fits))
            size += int(sizes[:fits].sum())
            batch = batch.slice(fits)
            if size < ARRAY_BYTES:
                continue
            rows = pa.Table.from_batches(held)
            anchor = rows.column("anchor").to_numpy()
            new = np.flatnonzero(anchor[1:] != anchor[:-1])
            if len(new):  # the last anchor may go on in the next rows
                cut = int(new[-1]) + 1
                yield spans(rows.slice(0, cut))
                held = rows.slice(cut).to_batches()
                size = sum(int(np.sum(pa.compute.binary_length(b.column("bytes")).to_numpy())) for b in held)
    if held:
        yield spans(pa.Table.from_batches(held))


def repeated_spans(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH,
    gram: int = GRAM, max_segments: int = MAX_SEGMENTS,
) -> DataFrame:
    """Spans that repeat earlier bytes: d, t, from, to; they may touch or overlap.

    Order of documents: id, null first, then the text's hash; rows with the same id and text are
    one document.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    all_ = segments(docs, id_col, text_col, length, gram)
    counts = anchor_counts(docs, id_col, text_col, length, gram)
    twice = _stored(counts.where("n > 1").select("anchor"), "anchors")
    members = _stored(all_.join(twice, "anchor"), "members")
    place = F.struct("d", "t", "start")
    distinct = members.groupBy("anchor", "seg").agg(
        F.min(place).alias("first"), F.first("n").alias("n")
    )
    distinct = _stored(distinct, "segments")
    several = (
        distinct.groupBy("anchor").agg(F.count(F.lit(1)).alias("_k")).where("_k > 1")
        .select("anchor", (F.col("_k") > max_segments).alias("crowded"))
    )
    copies = (
        members.join(distinct.select("anchor", "seg", "first"), ["anchor", "seg"])
        .where(~place.eqNullSafe(F.col("first")))
        .select("d", "t", F.col("start").cast("long").alias("from"),
                (F.col("start") + F.col("n") + (length - 1)).cast("long").alias("to"))
    )
    wanted = distinct.join(several, "anchor").select(
        "first.d", "first.t", F.struct("anchor", "first.start", "n", "crowded").alias("_s")
    ).groupBy("d", "t").agg(F.collect_list("_s").alias("wanted"))
    # one shuffle of whole texts; a crowded anchor's segments are cut to windows only when compared
    pieces = _stored(
        _keyed(docs, id_col, text_col)
        .join(wanted.withColumnsRenamed({"d": "_d", "t": "_t"}), _same_document())
        .select("d", "t", "text", "wanted")
        .mapInArrow(
            lambda batches: _pieces(batches, length),
            f"d {id_type}, t int, start long, anchor long, crowded boolean, bytes binary",
        ),
        "pieces",
    )
    compared = (
        pieces.where("NOT crowded").select("d", "t", "start", "anchor", "bytes")
        .repartition("anchor").sortWithinPartitions("anchor")
        .mapInArrow(lambda batches: _compare(batches, length), f"d {id_type}, t int, `from` long, `to` long")
    )
    single = pieces.where("crowded").select("d", "t", "start", "anchor", "bytes").mapInArrow(
        lambda batches: _single_windows(batches, length),
        f"d {id_type}, t int, start long, anchor long, window long",
    )
    firsts = single.groupBy("anchor", "window").agg(F.min(place).alias("first"))
    crowd = (
        single.join(firsts, ["anchor", "window"]).where(~place.eqNullSafe(F.col("first")))
        .select("d", "t", F.col("start").alias("from"), (F.col("start") + length).alias("to"))
    )
    return copies.unionByName(compared).unionByName(crowd)


def unite(spans: list[dict] | None) -> list[tuple[int, int]]:
    """Sorted spans without touching neighbours."""
    out: list[tuple[int, int]] = []
    for begin, end in sorted((s["from"], s["to"]) for s in spans or ()):
        if out and begin <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((begin, end))
    return out


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH,
    **options,
) -> DataFrame:
    """Texts without the bytes covered by a ``length``-byte string that also starts earlier.

    Result per row: id, n_bytes, n_removed, n_spans and the remaining bytes as ``kept`` (binary: a
    cut may fall inside a character).  Null counts as empty.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    spans = repeated_spans(docs, id_col, text_col, length, **options)
    listed = (
        spans.groupBy("d", "t").agg(F.collect_set(F.struct("from", "to")).alias("spans"))
        .withColumnsRenamed({"d": "_d", "t": "_t"})
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = Texts(batch.column(1))
            counts: list[tuple[int, int]] = []
            kept: list[bytes] = []
            for i, listed_spans in enumerate(batch.column(2).to_pylist()):
                text, parts, begin = texts.of(i), [], 0
                united = unite(listed_spans)
                for a, b in united:
                    parts.append(text[begin:a])
                    begin = b
                kept.append(b"".join([*parts, text[begin:]]))
                counts.append((sum(b - a for a, b in united), len(united)))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array(np.diff(texts.borders)),
                    pa.array([c[0] for c in counts], pa.int64()),
                    pa.array([c[1] for c in counts], pa.int64()), pa.array(kept, pa.binary()),
                ],
                names=[id_col, "n_bytes", "n_removed", "n_spans", "kept"],
            )

    return (
        _keyed(docs, id_col, text_col)
        .join(listed, _same_document(), "left")
        .select(F.col("d").alias(id_col), "text", "spans")
        .mapInArrow(cut, f"`{id_col}` {id_type}, n_bytes long, n_removed long, n_spans long, kept binary")
    )


def kept_digest(result: DataFrame) -> DataFrame:
    """The remaining bytes replaced by their SHA-256."""
    return result.withColumn("kept_sha256", F.sha2("kept", 256)).drop("kept")
