"""Queries over files: scans, texts, listings, containers, sinks and streams.

Each query's files are written to the session's shared folder by the tasks that read the table, one per page (and so they
grow with it), so that SQL over the tables knows what must come out. Pages are in files of five kinds, by their id.
"""

from __future__ import annotations

import io
import re
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwright.plans.catalogue import chunks_sql, query
from siftwright.session import shared_folder, table
from siftwright.sources import bitmaps, container, files, filewriter, logends, pdf, sinks
from siftwright.streaming import incremental, progress

_SUFFIXES = [".txt", ".MD", ".log", ".jpg", ".PNG"]
_HEADS = {3: "ffd8ffe0", 4: "89504e47"}
_SUFFIX_SQL = "CASE page_id % 5 " + " ".join(f"WHEN {k} THEN '{x}'" for k, x in enumerate(_SUFFIXES)) + " END"
#: Rows of the files: name, and the text of those that are texts.
_FILES = f"SELECT page_id, page_id % 5 AS kind, 'page_' || page_id || {_SUFFIX_SQL} AS name, 'page_' || page_id AS stem, url || chr(10) || 'en région' || chr(10) || html AS text FROM pages"


def _new_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/files_{uuid.uuid4().hex}"


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, kind, name, stem and text of the files."""
    kind = (F.col("page_id") % 5).cast("int")
    stem = F.concat(F.lit("page_"), F.col("page_id").cast("string"))
    suffix = F.element_at(F.array(*map(F.lit, _SUFFIXES)), kind + 1)
    return table(spark, sf_dir, "pages").select("page_id", kind.alias("kind"), F.concat(stem, suffix).alias("name"), stem.alias("stem"), F.concat("url", F.lit("\nen région\n"), "html").alias("text"))


def _content(rows: DataFrame) -> Column:
    """What the file of a page holds: its text, after the first bytes of an image where it is one."""
    head = reduce(lambda out, kv: out.when(F.col("kind") == kv[0], F.unhex(F.lit(kv[1]))), _HEADS.items(), F.when(F.lit(False), None)).otherwise(F.lit(b""))
    return F.concat(head, F.col("text").cast("binary"))


def _put(rows: DataFrame, folder: str, name: Column, content: Column) -> None:
    filewriter.write_files(rows.select(F.concat(F.lit(folder + "/"), name).alias("output_path"), content.alias("content")), folder)


def _part(number: Column) -> Column:
    """The folder of a file by its number, two thousand numbers a folder: tasks then write to folders of their own, and many
    tasks list them."""
    return F.concat(F.lit("part_"), F.floor(number / 2000).cast("string"))


def _page_files(spark: SparkSession, sf_dir: str, sounds: bool = False) -> str:
    """A folder with a file per page and, on request, a sound file per page one level below."""
    folder, pages = _new_folder(spark), _pages(spark, sf_dir)
    _put(pages, folder, F.col("name"), _content(pages))
    if sounds:
        _put(pages, folder, F.concat(F.lit("sub/"), "stem", F.lit(".wav")), F.lit(b"RIFF"))
    return folder


def _union(parts: dict[str, DataFrame], into: str) -> DataFrame:
    return reduce(DataFrame.unionByName, (rows.withColumn(into, F.lit(name)) for name, rows in parts.items()))


def _scan_sql() -> str:
    kinds = {"text": "kind <= 2", "any_case": "kind = 0", "image": "kind >= 3", "series": "kind >= 3", "face": "kind >= 3", "picture": "kind >= 3", "all": "true"}
    flat = " UNION ALL ".join(f"SELECT '{k}' AS scan, name FROM f WHERE {where}" for k, where in kinds.items())
    return f"WITH f AS ({_FILES}) {flat} UNION ALL SELECT 'audio', stem || '.wav' FROM f"


@query(_scan_sql())
def file_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC1, SC4-SC8, SC11, SC12, SC23: files of a folder by kind, at the top level or below."""
    folder = _page_files(spark, sf_dir, sounds=True)
    scans = {
        "text": files.require_files(files.listing(spark, folder, files.TEXT), files.TEXT),
        "any_case": files.listing(spark, folder, (".txt", ".md"), case_sensitive=True),
        "image": files.listing(spark, folder, files.IMAGES),
        "series": files.listing(spark, folder, files.SERIES_IMAGES),
        "face": files.listing(spark, folder, files.FACES),
        "picture": files.listing(spark, folder, files.PICTURES),
        "all": files.listing(spark, folder),
        "audio": files.listing(spark, folder, files.AUDIO, recursive=True),
        "audio_top": files.listing(spark, folder, files.AUDIO),
        "nowhere": files.listing(spark, folder + "/missing"),
    }
    return _union({kind: scan.select("name") for kind, scan in scans.items()}, "scan")


@query(f"WITH f AS ({_FILES}) SELECT name, left(text, 2000) AS text FROM f WHERE kind <= 2")
def file_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC14-SC16: texts of files up to a number of characters."""
    scan = files.listing(spark, _page_files(spark, sf_dir), files.TEXT, content=True)
    return files.texts(scan, 2000).select(F.regexp_extract("path", "[^/]*$", 0).alias("name"), "text")


@query(f"WITH f AS ({_FILES}) SELECT name, strlen(text)::BIGINT AS size, CASE kind WHEN 1 THEN 'text/markdown' ELSE 'text/plain' END AS mime, sha256(text) AS sha256 FROM f WHERE kind <= 2")
def file_forensics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN17, VX15: size, media type and content hash of files."""
    scan = files.listing(spark, _page_files(spark, sf_dir), files.TEXT, content=True)
    return files.forensics(scan).select(F.regexp_extract("path", "[^/]*$", 0).alias("name"), "size", "mime", "sha256")


@query(f"WITH f AS ({_FILES}) SELECT name FROM f WHERE kind >= 3")
def image_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC10: files that begin like the image that their name promises, at any depth."""
    scan = files.listing(spark, _page_files(spark, sf_dir), recursive=True, content=True)
    return files.decoded_images(scan).select("name")


@query(f"WITH f AS ({_FILES}) SELECT 'filter' AS part, 100000000 - page_id AS ordinal, name FROM f UNION ALL SELECT 'scan', row_number() OVER (ORDER BY name), name FROM f UNION ALL SELECT 'inside', 100000000 - page_id, name FROM f WHERE kind = 3")
def corpus_of_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC2, SC3, SC27: the corpus of a job: a filter's existing files in its order, else the scan; files inside a folder."""
    folder = _page_files(spark, sf_dir)
    scan = files.listing(spark, folder)
    pages = _pages(spark, sf_dir)
    place = lambda name: F.regexp_replace(F.concat(F.lit(folder + "/"), name), "^file:/*", "/")
    names = pages.select((F.lit(100_000_000) - F.col("page_id")).alias("ordinal"), place(F.col("name")).alias("path"))
    gone = pages.select(F.col("page_id").alias("ordinal"), place(F.col("stem")).alias("path"))
    found = files.corpus(scan, names.unionByName(gone))
    files.corpus_size(found)
    parts = {"filter": found, "scan": files.corpus(scan, None), "inside": files.inside(found, str(folder).replace("file://", ""), (".jpg",))}
    return _union({part: rows.select(F.col("ordinal").cast("bigint").alias("ordinal"), F.regexp_extract("path", "[^/]*$", 0).alias("name")) for part, rows in parts.items()}, "part")


@query(f"WITH f AS ({_FILES}) SELECT 'all' AS part, row_number() OVER (ORDER BY lower(name), name) AS ordinal, name FROM f WHERE kind >= 3 UNION ALL SELECT 'filter', page_id, name FROM f WHERE kind >= 3")
def images_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC5, SC7: images by case-folded name, or in a filter's order with the first mention counting."""
    folder = _page_files(spark, sf_dir)
    scan = files.listing(spark, folder)
    key = scan.join(_pages(spark, sf_dir).select("name", "page_id"), "name")
    chosen = key.select(F.explode(F.array("page_id", F.col("page_id") + 100_000_000)).alias("ordinal"), "path")
    parts = {"all": files.ordered_images(scan, None), "filter": files.ordered_images(scan, chosen)}
    return _union({part: rows.select(F.col("ordinal").cast("bigint").alias("ordinal"), F.regexp_extract("path", "[^/]*$", 0).alias("name")) for part, rows in parts.items()}, "part")


@query(f"WITH f AS ({_FILES}), e AS (SELECT 'dir_' || page_id AS name, true AS is_dir FROM f WHERE kind = 1 UNION ALL SELECT name, false FROM f WHERE kind IN (0, 3)) SELECT name, is_dir, row_number() OVER (ORDER BY NOT is_dir, lower(name), name) AS ordinal FROM e")
def directory_browse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC31: directories first, files by suffix."""
    shown = files.listing(spark, _page_files(spark, sf_dir)).select("name", F.lit(False).alias("is_dir"))
    folders = _pages(spark, sf_dir).where("kind = 1").select(F.concat(F.lit("dir_"), F.col("page_id").cast("string")).alias("name"), F.lit(True).alias("is_dir"))
    return files.browse(shown.unionByName(folders), (".txt", ".jpg"))


_LOG_SQL = "SELECT o_orderkey, o_orderkey || ' ' || o_orderstatus || ' ' || o_orderpriority || ' né' AS line FROM orders"


@query(f"""WITH l AS ({_LOG_SQL}), n AS (SELECT line, o_orderkey // 5000 AS log, row_number() OVER (PARTITION BY o_orderkey // 5000 ORDER BY o_orderkey) AS n, count(*) OVER (PARTITION BY o_orderkey // 5000) AS lines FROM l)
SELECT 'head' AS part, log, n, line FROM n WHERE n <= 10 UNION ALL SELECT 'tail', log, n - greatest(lines - 1000, 0), line FROM n WHERE n > lines - 1000""")
def head_and_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC24, SC25: first and last lines of every log of a folder; a log has up to 5,000 orders."""
    folder = _new_folder(spark)
    orders = table(spark, sf_dir, "orders")
    line = F.concat_ws(" ", F.col("o_orderkey").cast("string"), "o_orderstatus", "o_orderpriority", F.lit("né"))
    logs = orders.groupBy(F.floor(F.col("o_orderkey") / 5000).alias("log")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", line.alias("line")))), lambda x: x["line"]), "\n").alias("text"))
    _put(logs, folder, F.concat(F.lit("log_"), F.col("log").cast("string"), F.lit(".log")), F.concat("text", F.lit("\n")).cast("binary"))
    ends = {"head": logends.head(spark, folder, 10), "tail": logends.tail(spark, folder, 1000)}
    return _union({part: rows.select(F.regexp_extract("path", r"log_(\d+)", 1).cast("bigint").alias("log"), "n", "line") for part, rows in ends.items()}, "part")


@query("SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 1 ELSE 0 END AS is_real FROM customer WHERE c_acctbal >= 0")
def labelled_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC13: pictures with the label that their path tells."""
    kind = F.when(F.col("c_mktsegment") == "BUILDING", "/R_").otherwise("/F_")
    scan = table(spark, sf_dir, "customer").select("c_custkey", F.concat(kind, "c_name", F.when(F.col("c_acctbal") >= 0, ".JPG").otherwise(".txt")).alias("path"))
    return files.labelled_images(scan).select("c_custkey", "is_real")


@query("SELECT c_mktsegment AS source, c_mktsegment || '_' || c_name AS new_name FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_name) AS rn FROM customer) WHERE rn <= 7")
def labelled_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC30: at most n files of every source, a sampling operator."""
    scan = table(spark, sf_dir, "customer").select("c_mktsegment", F.concat(F.lit("/x/"), "c_name").alias("path"), F.col("c_name").alias("name"))
    return files.labelled_sample(scan, "c_mktsegment", 7).select("source", "new_name")


@query("WITH m AS (SELECT p_name || p_partkey || CASE WHEN p_size < 10 THEN '.webp' ELSE '.png' END AS filename, p_type, p_retailprice FROM part) SELECT filename, CASE WHEN p_retailprice >= 1000 THEN 'R_' ELSE 'F_' END || filename AS new_name FROM m WHERE p_type = 'ECONOMY' AND filename NOT LIKE '%.webp' ORDER BY filename LIMIT 100")
def evaluation_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC29: test files of a metadata table, named by their ground truth, up to a number."""
    name = F.concat("p_name", F.col("p_partkey").cast("string"), F.when(F.col("p_size") < 10, ".webp").otherwise(".png"))
    split, truth = F.when(F.col("p_type") == "ECONOMY", "Test").otherwise("Train"), F.when(F.col("p_retailprice") >= 1000, "Real").otherwise("fake")
    return files.evaluation_files(table(spark, sf_dir, "part").select(name.alias("filename"), split.alias("split"), truth.alias("ground_truth")), 100)


@query("SELECT count(*) AS n, count(*) AS ids, true AS known, true AS varied FROM customer")
def prompt_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC33: random attributes for as many people as there are customers, repeatable by seed."""
    rows = files.prompts(spark, {"colour": ["red", "blue"], "size": ["s", "m", "l"]}, table(spark, sf_dir, "customer").count(), 7)
    known = F.col("colour").isin("red", "blue") & F.col("size").isin("s", "m", "l")
    return rows.agg(F.count("*").alias("n"), F.countDistinct("id").alias("ids"), F.bool_and(known).alias("known"), (F.countDistinct("colour", "size") == 6).alias("varied"))


_PIXELS = 20  # pixels of a row of the pictures below


@query(f"""WITH p AS (SELECT doc_id, hex(encode(text)) AS h, strlen(text) // {3 * _PIXELS} AS rows, doc_id % 25 - 3 AS x, doc_id % 5 AS y, 1 + doc_id % 9 AS w, 1 + doc_id % 11 AS hh FROM documents),
b AS (SELECT *, greatest(0, least(x, {_PIXELS})) AS l, greatest(0, least(y, rows)) AS t FROM p), c AS (SELECT *, least({_PIXELS}, greatest(l, x + w)) AS r, least(rows, greatest(t, y + hh)) AS e FROM b)
SELECT doc_id, sha256(unhex(array_to_string([substr(h, (i * {_PIXELS} + l) * 6 + 1, (r - l) * 6) FOR i IN range(t, e)], ''))) AS face_id FROM c""")
def crop_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """VX16: the digest of a box of pixels, clipped at the borders; the pictures are the bytes of documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("binary").alias("pixels"))
    rows = F.floor(F.octet_length("pixels") / (3 * _PIXELS)).cast("int")
    number = F.col("doc_id").cast("int")
    box = [number % 25 - 3, number % 5, 1 + number % 9, 1 + number % 11]
    return docs.select("doc_id", bitmaps.crop_digest(F.col("pixels"), F.lit(_PIXELS), rows, box).alias("face_id"))


@query()
def perceptual_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """VX14: perceptual hashes of bitmap files that are made from the bytes of documents and read again; shorter texts, and
    every seventh file, which is cut off, are no bitmaps."""
    folder = _new_folder(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("b"))
    rows = F.floor(F.octet_length("b") / 96).cast("int")
    made = bitmaps.bmp_of(F.substr("b", F.lit(1), rows * 96), 32, rows)
    cut = F.when(F.col("doc_id") % 7 == 0, F.substr(made, F.lit(1), F.octet_length(made) - 1)).otherwise(made)
    _put(docs, folder, F.concat(_part(F.col("doc_id")), F.lit("/i_"), F.col("doc_id").cast("string"), F.lit(".bmp")), cut)
    scan = files.listing(spark, folder, files.IMAGES, recursive=True, content=True)
    return scan.select(F.regexp_extract("path", r"i_(\d+)", 1).cast("bigint").alias("doc_id"), bitmaps.perceptual_hash(F.col("content")).alias("pdq_hash"))


def _zipped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Containers from rows of (name, entries): a prefix and an archive; every other entry is packed."""
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            held = io.BytesIO(b"<meta/>")
            held.seek(0, io.SEEK_END)
            with zipfile.ZipFile(held, "w") as archive:
                for e in row["entries"]:
                    archive.writestr(f"docs/{e['stem']}/text.txt", e["text"].encode(), zipfile.ZIP_DEFLATED if e["page_id"] % 2 else zipfile.ZIP_STORED)
            out.append(held.getvalue())
        yield pa.RecordBatch.from_arrays([batch.column("name"), pa.array(out, pa.binary())], names=["name", "content"])


def _containers(spark: SparkSession, sf_dir: str) -> str:
    """A container per twenty pages, with a file per page."""
    folder = _new_folder(spark)
    name = F.concat(F.lit("case_"), F.floor(F.col("page_id") / 20).cast("string"))
    grouped = _pages(spark, sf_dir).groupBy(name.alias("name")).agg(F.array_sort(F.collect_list(F.struct("page_id", "stem", "text"))).alias("entries"))  # twenty a group
    made = grouped.mapInArrow(_zipped, "name string, content binary")
    _put(made, folder, F.concat("name", F.lit(".ufdr")), F.col("content"))
    return folder


_TREE = f"""f AS ({_FILES}), c AS (SELECT *, 'case_' || page_id // 20 AS container FROM f), t AS (SELECT container, '/docs/' || stem || '/text.txt' AS path, false AS is_dir, strlen(text)::BIGINT AS size, text FROM c
UNION ALL SELECT container, '/docs/' || stem, true, 0, NULL FROM c UNION ALL SELECT DISTINCT container, d, true, 0, NULL FROM c, (VALUES ('/'), ('/docs')) v(d)
UNION ALL SELECT DISTINCT container, '/metadata.xml', false, 7, '<meta/>' FROM c)"""


def _container_name() -> Column:
    return F.regexp_extract("container", r"([^/]*)\.ufdr$", 1).alias("container")


@query(f"WITH {_TREE} SELECT container, path, is_dir, size, sha256(text) AS sha256 FROM t")
def container_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC18, UD16: entries of evidence containers, read range by range of their directories, and the directories above them."""
    tree = container.read(spark, _containers(spark, sf_dir), range_entries=7)
    return tree.select(_container_name(), "path", "is_dir", "size", F.sha2("content", 256).alias("sha256"))


@query(f"WITH {_TREE} SELECT container, 'root' AS folder, substr(path, 2) AS name, is_dir, size FROM t WHERE path IN ('/docs', '/metadata.xml') UNION ALL SELECT container, 'docs', substr(path, 7), is_dir, size FROM t WHERE is_dir AND path LIKE '/docs/%'")
def container_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC19: what lies directly in a directory of a container."""
    tree = container.read(spark, _containers(spark, sf_dir), content=False)
    parts = {name: container.children(tree, path) for path, name in (("/", "root"), ("/docs", "docs"))}
    return _union(parts, "folder").select(_container_name(), "folder", "name", "is_dir", "size")


@query(f"WITH {_TREE} SELECT container, part, substr(text, b + 1, 30) AS data FROM t, (VALUES ('stored', 4, 3), ('packed', 5, 60)) v(part, page, b) WHERE path = '/docs/page_' || page || '/text.txt'".replace("substr(text", "substr(replace(text, 'é', 'ee')"))
def container_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC20: bytes of an entry, stored or packed, without reading the rest of its container."""
    folder = _containers(spark, sf_dir)
    parts = {name: container.read_range(spark, folder, f"/docs/page_{page}/text.txt", begin, 30) for name, page, begin in (("stored", 4, 3), ("packed", 5, 60))}
    return _union(parts, "part").select(_container_name(), "part", F.col("data").cast("string").alias("data"))


_ESCAPES = {b"\\": rb"\\", b"(": rb"\(", b")": rb"\)", b"\r": rb"\r", b"\n": rb"\n"}
_PAGE, _KIDS, _BOUND = 1500, 8, 50  # characters of a page below, children of a node of the tree, documents of a file


def _pdf(number: int, texts: list[str]) -> bytes:
    """Texts as one PDF, each on pages of its own: by its number with plain or packed streams, object streams, and codes of one
    byte for plain letters; every seventh is cut off."""
    packed = number % 3 == 1
    objects: dict[int, bytes] = {}

    def stream(key: int, data: bytes, packed: bool = packed) -> None:
        data, name = (zlib.compress(data), b"/Filter /FlateDecode ") if packed else (data, b"")
        objects[key] = b"<< %b/Length %d >>\nstream\n%b\nendstream" % (name, len(data), data)

    def shown(line: str, plain: bool) -> bytes:
        data = line.encode() if plain else line.encode("utf-16-be", "surrogatepass")
        if packed:
            return b"<%b>" % data.hex().encode()
        escape = (lambda m: b"\\%03o" % m[0][0]) if number % 2 else (lambda m: _ESCAPES[m[0]])
        return b"(%b)" % re.sub(rb"[\\()\r\n]", escape, data)

    ranges = b"".join(b"<%02x00> <%02xff> <%02x00>\n" % (k, k, k) for k in range(256))
    stream(5, b"begincmap 256 beginbfrange\n" + ranges + b"endbfrange endcmap", True)
    objects[3] = b"<< /Type /Font /Subtype /Type1 /Encoding /WinAnsiEncoding >>"
    objects[4] = b"<< /Type /Font /Subtype /Type0 /Encoding /Identity-H /ToUnicode 5 0 R >>"
    level, key = [], 6
    for text in texts:
        plain = number % 3 > 0 and text.isascii()
        for at in range(0, max(1, len(text)), _PAGE):
            lines = b" T*\n".join(shown(line, plain) + b" Tj" for line in text[at : at + _PAGE].split("\n"))
            stream(key, b"BT /F%d 12 Tf 14 TL 72 720 Td\n%b\nET" % (1 if plain else 2, lines))
            objects[key + 1] = b"<< /Type /Page /Contents [%d 0 R] >>" % key
            level, key = [*level, key + 1], key + 2
    while True:
        nodes = [level[k : k + _KIDS] for k in range(0, len(level), _KIDS)]
        for k, node in enumerate(nodes):
            objects[key + k] = b"<< /Type /Pages /Kids [%b] >>" % b" ".join(b"%d 0 R" % x for x in node)
        level, key = list(range(key, key + len(nodes))), key + len(nodes)
        if len(level) == 1:
            break
    objects[2] = objects.pop(level[0])[:-2] + b"/Resources << /Font << /F1 3 0 R /F2 4 0 R >> >> >>"
    objects[1] = b"<< /Type /Catalog /Pages 2 0 R >>"
    if packed:
        small = {k: objects.pop(k) for k in sorted(objects) if not objects[k].endswith(b"endstream")}
        places, body = [], []
        at = 0
        for k, held in small.items():
            places.append(b"%d %d" % (k, at))
            body.append(held + b"\n")
            at += len(held) + 1
        head = b" ".join(places) + b" "
        data = zlib.compress(head + b"".join(body))
        objects[key] = b"<< /Type /ObjStm /N %d /First %d /Filter /FlateDecode /Length %d >>\nstream\n%b\nendstream" % (len(small), len(head), len(data), data)
    whole = b"%PDF-1.7\n" + b"".join(b"%d 0 obj\n%b\nendobj\n" % kv for kv in objects.items()) + b"trailer\n<< /Root 1 0 R >>\n%%EOF\n"
    return whole if number % 7 else whole[: len(whole) * 3 // 4]


def _pdfs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for number, texts in zip(batch.column("number").to_pylist(), batch.column("texts")):
            made = _pdf(number, [x["text"] for x in texts.as_py()])
            yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([made], pa.binary())], names=["number", "content"])


@query(f"""SELECT doc_id // {_BOUND} AS number, CASE WHEN any_value(doc_id // {_BOUND}) % 7 = 0 THEN 0 ELSE sum(greatest(1, (length(text) + {_PAGE - 1}) // {_PAGE}))::BIGINT END AS pages,
sha256(CASE WHEN any_value(doc_id // {_BOUND}) % 7 = 0 THEN '' ELSE string_agg(text, '' ORDER BY doc_id, text) END) AS sha256 FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents) GROUP BY 1""")
def pdf_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC17: texts of PDF files, made of fifty documents each, with every document on pages of its own; those that are cut off
    have none."""
    folder = _new_folder(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "16m")
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    bound = docs.groupBy(F.floor(F.col("doc_id") / _BOUND).alias("number")).agg(F.array_sort(F.collect_list(F.struct("doc_id", "text"))).alias("texts"))  # fifty a group
    made = bound.mapInArrow(_pdfs, "number bigint, content binary")
    _put(made, folder, F.concat(F.lit("d_"), F.col("number").cast("string"), F.lit(".pdf")), F.col("content"))
    read = pdf.texts(files.listing(spark, folder, (".pdf",), content=True))
    return read.select(F.regexp_extract("path", r"d_(\d+)", 1).cast("bigint").alias("number"), "pages", F.sha2("text", 256).alias("sha256"))


@query("SELECT 'appended' AS sink, s_suppkey AS key, s_name AS name, s_acctbal AS value FROM supplier, range(2) UNION ALL SELECT 'replaced', s_suppkey, s_name, s_acctbal FROM supplier UNION ALL SELECT 'csv', s_suppkey, s_name, s_acctbal FROM supplier")
def table_sinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SK1, SK2, SK4, SK7, SK8: rows appended, replaced and exported, read back."""
    folder, rows = _new_folder(spark), table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("value"))
    sinks.discard(rows)
    for _ in range(2):
        sinks.append(rows, f"{folder}/appended")
        sinks.replace_all(rows, f"{folder}/replaced")
    sinks.csv(rows, f"{folder}/csv")
    back = {"appended": spark.read.parquet(f"{folder}/appended"), "replaced": spark.read.parquet(f"{folder}/replaced"), "csv": spark.read.option("header", True).schema(rows.schema).csv(f"{folder}/csv")}
    return _union(back, "sink")


@query("SELECT p_partkey, '/out/' || p_name || '.a.png.txt' AS whole, '/out/' || p_name || '.a.txt' AS stem, p_brand AS text FROM part")
def text_output_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SK5: one text file per input, named by its whole name or its stem."""
    rows = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("/in/d/"), "p_name", F.lit("."), F.lit("a.png")).alias("path"), F.col("p_brand").alias("text"))
    keyed = rows.withColumn("path", F.concat("path", F.lit("")))
    whole, stem = sinks.text_outputs(keyed, "/out/"), sinks.text_outputs(keyed, "/out", whole_name=False)
    names = whole.select("input_path", F.col("output_path").alias("whole")).distinct().join(stem.select("input_path", F.col("output_path").alias("stem")).distinct(), "input_path")
    return rows.join(names, rows["path"] == names["input_path"]).select("p_partkey", "whole", "stem", "text")


@query("""WITH r AS (SELECT doc_id, '/in/' || (doc_id // 2) || CASE WHEN doc_id % 2 = 0 THEN '.png' ELSE '.jpg' END AS path, coalesce(text, '') AS text FROM documents),
n AS (SELECT *, (doc_id // 2)::VARCHAR AS stem, row_number() OVER (PARTITION BY doc_id // 2 ORDER BY path) AS rn FROM r)
SELECT CASE WHEN rn = 1 THEN stem ELSE stem || '.' || left(sha256(path || chr(10) || text), 16) END AS name, sha256(text) AS sha256, strlen(text)::BIGINT AS size FROM n""")
def written_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SK5, SK9: every document's text as a file of its own below a chosen folder, over older files, and read again. Two
    inputs have each stem; both texts are kept."""
    folder = sinks.fallback_folder(_new_folder(spark), True, "/scratch")
    suffix = F.when(F.col("doc_id") % 2 == 0, ".png").otherwise(".jpg")
    path = F.concat(F.lit("/in/"), F.floor(F.col("doc_id") / 2).cast("string"), suffix)
    rows = table(spark, sf_dir, "documents").select("doc_id", path.alias("path"), "text")
    older = rows.where("doc_id % 2 = 1").withColumn("text", F.lit("older"))
    for texts in (older, rows):
        sinks.write_texts(sinks.text_outputs(texts, folder, whole_name=False, below=_part(F.col("doc_id"))), folder)
    read = files.forensics(files.listing(spark, folder, (".txt",), recursive=True, content=True))
    return read.select(F.regexp_extract("path", r"([^/]*)\.txt$", 1).alias("name"), "sha256", "size")


@query(chunks_sql(f"SELECT stem AS path, text FROM ({_FILES})") + "SELECT path, chunk_index, chunk_text, 256 AS dimensions FROM chunks")
def streamed_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST4, DM1, SK1: new files are embedded once, with all chunks of their texts, however often the stream runs."""
    folder, pages = _new_folder(spark), _pages(spark, sf_dir)
    for part in ("page_id % 2 = 0", "page_id % 2 = 1", "page_id % 5 = 0"):  # in a third run files are written again
        some = pages.where(part)
        if "5" not in part:
            _put(some, f"{folder}/in", F.concat("stem", F.lit(".txt")), F.col("text").cast("binary"))
        incremental.embed_stream(spark, f"{folder}/in", f"{folder}/table", f"{folder}/state").awaitTermination()
    stored = spark.read.parquet(f"{folder}/table")
    return stored.select(F.regexp_extract("path", r"([^/]*)\.txt$", 1).alias("path"), F.col("chunk_index").cast("int").alias("chunk_index"), "chunk_text", F.size("embedding").alias("dimensions"))


@query("""SELECT o_orderkey AS key, '{"o_orderkey":' || o_orderkey || ',"o_orderstatus":"' || o_orderstatus || '","o_orderpriority":"' || o_orderpriority || '"}' AS line FROM orders""")
def response_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST1: rows as JSON lines, as a response sends them, written by the tasks and read again as a stream."""
    folder = _new_folder(spark)
    incremental.json_lines(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")).write.text(f"{folder}/lines")
    incremental.append_lines(spark, f"{folder}/lines", f"{folder}/seen", f"{folder}/state").awaitTermination()
    return spark.read.parquet(f"{folder}/seen").select(F.get_json_object("line", "$.o_orderkey").cast("bigint").alias("key"), "line")


@query("SELECT count(*) AS rows, 4::BIGINT AS batches, true AS in_order FROM orders")
def stream_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST3: the progress of a stream as rows: each batch's input, adding up to the table."""
    folder = _new_folder(spark)
    table(spark, sf_dir, "orders").repartition(4).write.parquet(f"{folder}/in")
    with progress.recorded(spark, f"{folder}/progress"):
        orders = spark.readStream.schema(table(spark, sf_dir, "orders").schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
        orders.writeStream.queryName("orders").format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    rows = progress.read(spark, f"{folder}/progress").where("name = 'orders' AND input_rows > 0")
    return rows.agg(F.sum("input_rows").alias("rows"), F.count("*").alias("batches"), (F.max("batch") == F.count("*") - 1).alias("in_order"))
