"""Interleaved document sequences: ordered text and media references of HTML, with payloads resolved by digest.

sequence() parses a page into its items in order: texts, and media with source, caption (figcaption, else alt) and position.
payloads() stores media as images of 8-bit samples (binary PPM, 64 pixels a row: 192 bytes), one row for each digest a task meets;
measured() reads them back and computes features. resolve() joins references to media by digest, so a payload that many documents
share is stored and measured once, and positions and captions stay with their references. Both sides of that join are plain tables,
so Spark can split a digest that many documents share.

pages_of() renders documents as pages: their own lines as paragraphs, a mark of their source before them, and the payload as a figure
in their middle, so references stand between texts as on real pages.

Null text: an empty payload, which is padded to 192 spaces. References whose digest is unknown stay, with nulls. Rows of equal id
are separate documents. An empty table gives no rows. Columns of a page table that are called like a result (items, position, caption, the
measures) are left out. A very long text is held by one worker, with its page and its payload.
"""

from __future__ import annotations

import hashlib
import html
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, stored, table
from .dom import BLOCK, Node, parse
from .sharding import CRC_TABLE, bytes_sql, crc_sql

ROW, WIDTH = 192, 64
URN = "urn:sha256:"
_REFERENCES = {"img": "src", "video": "src", "audio": "src", "source": "src", "embed": "src", "object": "data"}


def padded(payload: bytes) -> bytes:
    """payload and spaces up to a positive multiple of ROW."""
    return payload.ljust(max(1, -(-len(payload) // ROW)) * ROW)


def to_image(payload: bytes) -> bytes:
    """A binary PPM whose samples are the bytes of payload (a positive multiple of ROW)."""
    return b"P6\n%d %d\n255\n" % (WIDTH, len(payload) // ROW) + payload


def from_image(image: bytes) -> bytes:
    kind, size, depth, samples = image.split(b"\n", 3)
    width, height = map(int, size.split())
    if kind != b"P6" or depth != b"255" or width * height * 3 != len(samples):
        raise ValueError("not a PPM of 8-bit samples")
    return samples


def feature(samples: bytes) -> str:
    """Size, mean of each channel, and an 8 x 8 average hash of the brightness: which cells are brighter than the whole, in exact integers."""
    x = np.frombuffer(samples, np.uint8).reshape(-1, WIDTH, 3)
    light = x.sum(axis=2, dtype=np.int64)
    rows = np.unique(np.arange(8) * len(light) // 8)
    cells = np.add.reduceat(light.reshape(len(light), 8, 8).sum(axis=2), rows, axis=0)
    area = np.diff([*rows, len(light)]) * 8
    total, pixels = int(light.sum()), light.size
    bits = "".join("01"[int(c) * pixels > total * int(a)] for line, a in zip(cells, area, strict=True) for c in line).ljust(64, "0")
    mean = x.reshape(-1, 3).mean(axis=0)
    return f"{WIDTH}x{len(x)};rgb={mean[0]:.3f},{mean[1]:.3f},{mean[2]:.3f};ahash={int(bits, 2):016x}"


def sequence(page: str | None) -> list[dict]:
    """The items of a page in order: position, kind (text or media), text, source, caption."""
    items: list[dict] = []
    held: list[str] = []

    def flush() -> None:
        text = " ".join("".join(held).split())
        held.clear()
        if text:
            items.append({"position": len(items), "kind": "text", "text": text, "source": None, "caption": None})

    def words(x: Node) -> str:
        return x.text if not x.tag else "".join(map(words, x.children))

    stack: list = [(parse(page), None)]
    while stack:
        x, figure = stack.pop()
        if x is None:
            flush()
        elif not x.tag:
            held.append(x.text)
        elif x.tag == "figcaption" and figure is not None:
            continue  # it goes with the figure's media
        else:
            source = x.get(_REFERENCES[x.tag]) if x.tag in _REFERENCES else None
            if source:
                flush()
                caption = next((" ".join(words(c).split()) for c in figure.children if c.tag == "figcaption"), None) if figure is not None else None
                items.append({"position": len(items), "kind": "media", "text": None, "source": source, "caption": caption or x.get("alt")})
            if x.tag in BLOCK:
                flush()
                stack.append((None, None))
            inner = x if x.tag == "figure" and any(c.tag == "figcaption" for c in x.children) else figure
            stack.extend((c, inner) for c in reversed(x.children))
    flush()
    return items


ITEMS = "array<struct<position:int,kind:string,text:string,source:string,caption:string>>"
_ITEM = pa.list_(pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("source", pa.string()), ("caption", pa.string())]))


def sequences(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """pages without its html column, with items: the sequence of each page."""
    keep = [c for c in pages.columns if c not in (html_col, "items")]
    fields = "".join(f"`{c}` {pages.schema[c].dataType.simpleString()}, " for c in keep)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items = pa.array([sequence(x.as_py()) for x in batch.column(len(keep))], _ITEM)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], items], [*keep, "items"])

    lean(pages.sparkSession)
    return pages.select(*keep, html_col).mapInArrow(run, f"{fields}items {ITEMS}")


def _payload(text: str | None) -> tuple[int, bytes, str]:
    """Bytes of the text, the padded payload, and its digest."""
    payload = (text or "").encode("utf-8", "surrogatepass")
    whole = padded(payload)
    return len(payload), whole, hashlib.sha256(whole).hexdigest()


def page_of(text: str | None, source: str | None, digest: str) -> str:
    """The lines of a text as paragraphs, around a figure that refers to its payload."""
    lines = html.escape(text or "", quote=False).split("\n")
    name = html.escape(source or "")
    mark = hashlib.sha256(padded((source or "").encode("utf-8", "surrogatepass"))).hexdigest()
    half = len(lines) // 2
    paragraphs = ["<p>" + x + "</p>" if x.strip() else "" for x in lines]
    figure = f"<figure><figcaption>{name} {PAYLOAD}</figcaption><img src='{URN}{digest}' alt='{PAYLOAD}'></figure>"
    return f"<article><img src='{URN}{mark}' alt='{name}'>{''.join(paragraphs[:half])}{figure}{''.join(paragraphs[half:])}</article>"


PAYLOAD = "payload"


def pages_of(docs: DataFrame) -> DataFrame:
    """docs: doc_id, source, text. doc_id, n_bytes, digest (of its payload) and html (see page_of)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for source, text in zip(batch.column(1), batch.column(2), strict=True):
                text = text.as_py()
                n, _, digest = _payload(text)
                rows.append((n, digest, page_of(text, source.as_py(), digest)))
            n, digest, page = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(digest, pa.string()), pa.array(page, pa.string())], ["doc_id", "n_bytes", "digest", "html"])

    lean(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("source").cast("string"), "text").mapInArrow(run, f"doc_id {kind}, n_bytes long, digest string, html string")


def payloads(docs: DataFrame) -> DataFrame:
    """docs: text. digest and media (the stored form) of each text's payload, once for each task that meets it."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[str] = set()
        for batch in batches:
            rows = []
            for text in batch.column(0):
                _, whole, digest = _payload(text.as_py())
                if digest not in seen:
                    seen.add(digest)
                    rows.append((digest, to_image(whole)))
            digest, media = zip(*rows, strict=True) if rows else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(digest, pa.string()), pa.array(media, pa.binary())], ["digest", "media"])

    lean(docs.sparkSession)
    return docs.select("text").mapInArrow(run, "digest string, media binary")


def measured(store: DataFrame) -> DataFrame:
    """store: digest, media (as written). One row per digest: what its bytes, read back, hold."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for media in batch.column(1):
                image = media.as_py()
                samples = from_image(image)
                rows.append((len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-16:]), len(image), hashlib.sha256(image).hexdigest(), feature(samples)))
            columns = list(zip(*rows, strict=True)) or [()] * 6
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], ["digest", *MEASURES])

    lean(store.sparkSession)
    own = store.select("digest", "media").mapInArrow(run, "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
    return own.groupBy("digest").agg(*[F.first(c).alias(c) for c in MEASURES])


MEASURES = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]


def resolve(items: DataFrame, media: DataFrame) -> DataFrame:
    """items: a table with items (see sequences). A row per media reference, with its position and caption and what media (a stored table of
    measured()) has for its digest."""
    keep = [c for c in items.columns if c not in ("items", "position", "caption", *MEASURES)]
    refs = items.select(*keep, F.explode(F.filter("items", lambda x: x["kind"] == "media")).alias("_item"))
    refs = refs.select(*keep, F.col("_item.position").alias("position"), F.col("_item.caption").alias("caption"), F.regexp_extract("_item.source", f"^{URN}([0-9a-f]{{64}})$", 1).alias("_digest"))
    return refs.join(media, refs["_digest"] == media["digest"], "left").select(*[refs[c] for c in keep], "position", "caption", *[media[c] for c in MEASURES])


def op8_interleaved_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    store = stored(payloads(docs))
    media = stored(measured(store))
    refs = resolve(sequences(pages_of(docs).drop("digest")), media)
    return refs.where(F.col("caption").endswith(f" {PAYLOAD}")).select("doc_id", "n_bytes", *MEASURES, "position", "caption")


ORACLE = rf"""
WITH {CRC_TABLE},
d AS (SELECT doc_id, source, coalesce(text, '') t, strlen(coalesce(text, ''))::BIGINT n, greatest(1, (strlen(coalesce(text, '')) + 191) // 192) h FROM documents),
p AS (SELECT doc_id, source, t, n, h, encode(t) || encode(repeat(' ', (192 * h - n)::INT)) payload FROM d),
m AS (SELECT *, encode('P6' || chr(10) || '{WIDTH} ' || h || chr(10) || '255' || chr(10)) || payload AS media, {bytes_sql('payload')} b FROM p),
u AS (SELECT doc_id, h, unnest(b) v, unnest(range(192 * h)) i FROM m),
c AS (SELECT doc_id, h, avg(v) FILTER (i % 3 = 0) r, avg(v) FILTER (i % 3 = 1) g, avg(v) FILTER (i % 3 = 2) b, sum(v) total FROM u GROUP BY doc_id, h),
k AS (SELECT doc_id, h, CASE WHEN h < 8 THEN i // 192 ELSE (8 * (i // 192 + 1) - 1) // h END y, i % 192 // 24 x, sum(v) light, count(*) // 3 area FROM u GROUP BY ALL),
a AS (SELECT doc_id, sum(CASE WHEN light * 64 * k.h > total * area THEN 1::UBIGINT << (63 - 8 * y - x) ELSE 0 END)::UBIGINT hash FROM k JOIN c USING (doc_id) GROUP BY doc_id),
l AS (SELECT doc_id, list_filter(list_transform(string_split(t, chr(10)), lambda x, i: CASE WHEN i <= len(string_split(t, chr(10))) // 2 AND regexp_matches(x, '[^\x20\x09-\x0D]') THEN 1 ELSE 0 END), lambda x: x = 1) before FROM d)
SELECT doc_id, m.n n_bytes, 192 * m.h payload_bytes, sha256(payload) payload_sha256, {crc_sql('m.b[-16:]')}::BIGINT tail_crc32, octet_length(media)::BIGINT media_bytes, sha256(media) media_sha256,
  format('{WIDTH}x{{}};rgb={{:.3f}},{{:.3f}},{{:.3f}};ahash={{:016x}}', m.h, c.r, c.g, c.b, a.hash) feature, (1 + len(before))::INT AS position, trim(coalesce(m.source, '') || ' {PAYLOAD}') AS caption
FROM m JOIN c USING (doc_id) JOIN a USING (doc_id) JOIN l USING (doc_id), crc
"""
