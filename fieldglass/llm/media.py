"""Interleaved documents: HTML to ordered items of text and media references, joined by digest to stored media.

`parse_html` gives each page a sequence of items (position, kind, text, reference, caption); `resolve` joins the
references to a table of media by digest and puts the sequences together again, so positions and captions stay aligned
with what was found. `store` writes payloads as 8-bit grey PNG images, losslessly, beside the HTML that refers to them.

Defined cases: a null or empty page has no items; a null text is an empty payload, padded to one row of samples; equal
payloads are stored under one digest, once or a few times, and count as one; references that no media have keep their
place with nulls; repeated rows give a row each; an empty table gives no rows; extra columns are left alone.
"""

from __future__ import annotations

import hashlib
import html as html_lib
import struct
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldglass.llm.common import bounded_batches, id_and_text, join_counted, materialize, new_path

#: Samples in a row of the stored image.
WIDTH = 576
ITEM = pa.struct([("pos", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("ref", pa.string()), ("caption", pa.string())])
ITEM_DDL = "array<struct<pos int, kind string, text string, ref string, caption string>>"
MEDIA_TAGS = {"img": "image", "video": "video", "audio": "audio", "source": "source", "embed": "embed", "object": "object"}
HIDDEN_TAGS = {"script", "style", "noscript", "template"}
INLINE_TAGS = {"a", "abbr", "b", "bdi", "bdo", "cite", "code", "data", "em", "i", "kbd", "mark", "q", "s", "samp", "small", "span", "strong", "sub", "sup", "time", "u", "var"}


# ---- HTML ----


class _Items(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.items: list[list] = []
        self.text: list[str] = []
        self.hidden = 0
        self.figures: list[int] = []
        self.captions: list[list[str]] = []

    def flush(self) -> None:
        if words := " ".join("".join(self.text).split()):
            self.items.append(["text", words, None, None])
        self.text = []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in HIDDEN_TAGS:
            self.hidden += 1
        elif tag in MEDIA_TAGS:
            own = dict(attrs)
            if ref := own.get("src") or own.get("data"):
                self.flush()
                self.items.append([MEDIA_TAGS[tag], None, ref.strip(), own.get("alt") or own.get("title") or None])
        elif tag == "figcaption" and self.figures:
            self.flush()
            self.captions.append([])
        elif tag not in INLINE_TAGS:
            self.flush()
            if tag == "figure":
                self.figures.append(len(self.items))

    def handle_endtag(self, tag: str) -> None:
        if tag in HIDDEN_TAGS:
            self.hidden = max(0, self.hidden - 1)
        elif tag == "figcaption" and self.captions:
            words = " ".join("".join(self.captions.pop()).split())
            media = [x for x in self.items[self.figures[-1] :] if x[0] != "text"] if self.figures else []
            for x in media:
                x[3] = words or x[3]
            if not media and words:
                self.items.append(["text", words, None, None])
        elif tag not in INLINE_TAGS and tag not in MEDIA_TAGS:
            self.flush()
            if tag == "figure" and self.figures:
                self.figures.pop()

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            (self.captions[-1] if self.captions else self.text).append(data)


def items_of(page: str | None) -> list[dict]:
    parser = _Items()
    parser.feed(page or "")
    parser.close()
    while parser.captions:
        parser.handle_endtag("figcaption")
    parser.flush()
    return [{"pos": k, "kind": kind, "text": text, "ref": ref, "caption": caption} for k, (kind, text, ref, caption) in enumerate(parser.items)]


def parse_html(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """The key column and `items`."""
    bounded_batches(pages.sparkSession)
    key_type = pages.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([items_of(x) for x in batch.column(1).to_pylist()], pa.list_(ITEM))], names=[key, "items"])

    return pages.select(key, F.col(html).cast("string")).mapInArrow(run, f"`{key}` {key_type}, items {ITEM_DDL}")


def resolve(sequences: DataFrame, media: DataFrame, key: str, scheme: str = "urn:sha256:") -> DataFrame:
    """Adds `media`, the media row of each reference of the scheme, to every item. media: `digest`, unique, and what to carry.

    Items are joined one by one, and a digest that many pages refer to is broadcast with its media (join_counted), so it has
    no task of its own; what comes together again is one page.
    """
    found = F.struct(*(F.col(c) for c in media.columns)).alias("media")
    flat = sequences.select(key, F.posexplode_outer("items").alias("__at", "item"))
    flat = materialize(flat.withColumn("digest", F.when(F.col("item.ref").startswith(scheme), F.substring_index("item.ref", ":", -1))), "items", "zstd")
    refers = flat.where(F.col("digest").isNotNull())
    held = media.select("digest", found).join(refers.groupBy("digest").agg(F.count(F.lit(1)).alias("n")), "digest")
    joined = join_counted(refers, held, ["digest"], refers.count(), "left").drop("n")
    joined = joined.unionByName(flat.where(F.col("digest").isNull()).withColumn("media", F.lit(None).cast(joined.schema["media"].dataType)))
    whole = F.struct(F.col("__at").alias("pos"), F.col("item.kind").alias("kind"), F.col("item.text").alias("text"), F.col("item.ref").alias("ref"), F.col("item.caption").alias("caption"), F.col("media"))
    return joined.groupBy(key).agg(F.sort_array(F.collect_list(F.when(F.col("item").isNotNull(), whole))).alias("items"))


# ---- media ----


def png(payload: bytes, level: int = 4) -> bytes:
    """8-bit grey, WIDTH samples a row."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    raw = np.zeros((len(rows), WIDTH + 1), np.uint8)
    raw[:, 1:] = rows

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw.tobytes(), level)) + chunk(b"IEND", b"")


def samples(image: bytes) -> np.ndarray:
    """The samples of an image that `png` wrote, its checksums tested."""
    if image[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG")
    at, shape, data = 8, None, []
    while at < len(image):
        (n,) = struct.unpack_from(">I", image, at)
        kind, body = image[at + 4 : at + 8], image[at + 8 : at + 8 + n]
        if struct.unpack_from(">I", image, at + 8 + n)[0] != zlib.crc32(kind + body):
            raise ValueError("a chunk's checksum doesn't match")
        if kind == b"IHDR":
            width, height, *form = struct.unpack(">IIBBBBB", body)
            if form != [8, 0, 0, 0, 0]:
                raise ValueError("only 8-bit grey is read")
            shape = (height, width + 1)
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + n
    rows = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(shape)
    if rows[:, 0].any():
        raise ValueError("only unfiltered rows are read")
    return rows[:, 1:]


def payload_of(text: bytes) -> bytes:
    n = max(1, -(-len(text) // WIDTH)) * WIDTH
    return text + b"\xff" * (n - len(text))


def feature_of(rows: np.ndarray) -> str:
    """Size and mean brightness in an 8 by 8 grid, rows dealt to the grid's lines in turn."""
    bands = rows.reshape(len(rows), 8, -1).mean(2)
    grid = np.stack([bands[k::8].mean(0) if len(bands) > k else np.zeros(8) for k in range(8)])
    return f"{rows.shape[1]}x{rows.shape[0]}:" + np.rint(grid).astype(np.uint8).tobytes().hex()


STORED = pa.schema([("row_key", pa.string()), ("doc_id", pa.int64()), ("html", pa.string()), ("digest", pa.string()), ("media", pa.binary())])
STORED_DDL = "row_key string, doc_id long, html string, digest string, media binary"
FEATURES = pa.schema([("digest", pa.string()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])
FEATURES_DDL = "digest string, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def store(docs: DataFrame, path: str, remembered: int = 20_000) -> None:
    """Write for each text an HTML page that refers to its media by digest, and the media unless the task just wrote the same."""
    bounded_batches(docs.sparkSession, rows=500)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, n, known = TaskContext.get().partitionId(), 0, {}
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                payload = payload_of(text)
                own = hashlib.sha256(payload).digest()
                image = None
                if own not in known:
                    image = png(payload)
                    if len(known) >= remembered:
                        known.clear()
                    known[own] = hashlib.sha256(image).hexdigest()
                page = f'<article><h1>Document {doc_id}</h1><figure><img src="urn:sha256:{known[own]}" alt="text"><figcaption>Text of document {html_lib.escape(str(doc_id))}</figcaption></figure></article>'
                rows.append((f"{task}-{n}", doc_id, page, known[own], image))
                n += 1
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), STORED.types, strict=True)], schema=STORED)

    id_and_text(docs).mapInArrow(run, STORED_DDL).write.option("compression", "uncompressed").parquet(path)


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """What the stored bytes say, a row for each digest."""
    bounded_batches(spark, rows=500)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for digest, image in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = samples(image)
                payload = found.tobytes()
                rows.append((digest, len(payload.rstrip(b"\xff")), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(image), hashlib.sha256(image).hexdigest(), feature_of(found)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), FEATURES.types, strict=True)], schema=FEATURES)

    stored = spark.read.schema(STORED_DDL).parquet(path).where(F.col("media").isNotNull()).select("digest", "media")
    return stored.mapInArrow(run, FEATURES_DDL).dropDuplicates(["digest"])


def op1(docs: DataFrame) -> DataFrame:
    spark = docs.sparkSession
    path = new_path(spark, "media")
    store(docs, path)
    stored = spark.read.schema(STORED_DDL).parquet(path)
    sequences = parse_html(stored.select(F.struct("row_key", "doc_id").alias("page"), "html").withColumn("page", F.to_json("page")), "page")
    resolved = resolve(sequences, read_features(spark, path), "page")
    image = F.filter("items", lambda x: x["kind"] == "image")[0]
    own = F.from_json("page", "row_key string, doc_id long")
    out = resolved.select(own["doc_id"].alias("doc_id"), image.alias("item"), sequence_of(F.col("items")).alias("sequence"))
    return out.select("doc_id", *(F.col("item.media")[c].alias(c) for c in FEATURES.names if c != "digest"), F.col("item.pos").alias("position"), F.col("item.caption").alias("caption"), "sequence")


def sequence_of(items: Column) -> Column:
    """The ordered items as one line: position, kind, and the text or the caption and the digest of the media."""
    one = lambda x: F.concat_ws(" ", x["pos"].cast("string"), x["kind"], x["text"], x["caption"], x["media"]["media_sha256"])
    return F.array_join(F.transform(items, one), " | ")
