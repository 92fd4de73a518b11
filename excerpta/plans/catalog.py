"""The registered queries of the engine, each over whole tables, with their SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import detect, encryption, text, types, udfs
from ..operators import model, office
from . import extract as X
from . import synthesise

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        name = f.__name__
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _files(docs: DataFrame, ext: str, content: Column | None = None) -> DataFrame:
    """Table texts as files of a kind: the columns of ``binaryFile``."""
    if content is None:
        content = udfs.scalar(synthesise.BUILDERS[ext], "binary")(F.coalesce("text", F.lit("")))
    path = F.concat(F.lit("/in/doc"), F.col("doc_id").cast("string"), F.lit("." + ext))
    return docs.select("doc_id", path.alias("path"), F.lit("2024-01-02 03:04:05").cast("timestamp").alias("modificationTime"), F.length(content).cast("bigint").alias("length"), content.alias("content"))


def _bytes(c: Column | str = "text") -> Column:
    return F.encode(F.coalesce(c, F.lit("")), "UTF-8")


# ---- detection and routing ------------------------------------------------------------------------------

_EXTS = "docx pdf mp3 mp4 jpg tar.gz tar.bz2 unknown ts docm apk zzz xls html zip csv png md".split()


def _named(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id")
    ext = F.get(F.array(*map(F.lit, _EXTS)), (F.col("doc_id") % len(_EXTS)).cast("int"))
    return docs.select("doc_id", F.concat(F.lit("/a/b.c/f"), F.col("doc_id").cast("string"), F.lit("."), ext).alias("path"))


_NAMED = "select doc_id, ['" + "','".join(_EXTS) + f"'][1 + doc_id % {len(_EXTS)}] as ext from documents"


@query("select page_id, regexp_extract(regexp_extract(lower(regexp_replace(url, '[?#].*$', '')), '([^/]*)$', 1), '\\.([^.]*)$', 1) as ext from pages")
def ext_detect(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", detect.extension(F.regexp_replace("url", "[?#].*$", "")).alias("ext"))


_MIMES = {"docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "pdf": "application/pdf", "mp3": "audio/mpeg", "mp4": "video/mp4", "jpg": "image/jpeg", "tar.gz": "application/x-tar-gz", "tar.bz2": "application/x-tar-bz2", "ts": "application/typescript", "apk": "application/vnd.android.package-archive", "xls": "application/vnd.ms-excel", "html": "text/html", "zip": "application/zip", "csv": "text/csv", "png": "image/png", "md": "text/markdown"}
_MIME_CASE = "case ext " + " ".join(f"when '{e}' then '{m}'" for e, m in _MIMES.items()) + " else 'application/octet-stream' end"


@query(f"select doc_id, ext, {_MIME_CASE} as mime, case {_MIME_CASE} when 'audio/mpeg' then 'mp3' when 'video/mp4' then 'mp4' else '' end as back from ({_NAMED})")
def mime_lookup(spark: SparkSession, d: str) -> DataFrame:
    named = _named(spark, d).withColumn("ext", detect.extension(F.col("path")))
    dim = F.broadcast(types.type_dimension(spark).select("ext", "mime"))
    out = named.join(dim, "ext", "left").select("doc_id", "ext", F.coalesce("mime", F.lit(types.DEFAULT_MIME)).alias("mime"))
    return out.withColumn("back", types.extension_of_mime(F.col("mime")))


@query(f"select doc_id, ext from ({_NAMED}) where ext not in ('unknown', 'ts', 'apk', 'zzz')")
def supported_semi(spark: SparkSession, d: str) -> DataFrame:
    named = _named(spark, d).select("doc_id", detect.extension(F.col("path")).alias("ext"))
    return named.join(F.broadcast(types.type_dimension(spark).filter("supported").select("ext")), "ext", "left_semi").select("doc_id", "ext")


@query(f"select doc_id, ext from ({_NAMED}) where ext in ('unknown', 'ts', 'apk', 'zzz')")
def unsupported_anti(spark: SparkSession, d: str) -> DataFrame:
    named = _named(spark, d).select("doc_id", detect.extension(F.col("path")).alias("ext"))
    return named.join(F.broadcast(types.type_dimension(spark).filter("supported").select("ext")), "ext", "left_anti").select("doc_id", "ext")


@query(f"""select doc_id, ext, case when ext in ('ts', 'apk') then 'metadata_only' when ext in ('unknown', 'zzz') then null else ext end as routed,
    case ext when 'docm' then 'docx' when 'mp3' then 'audio' when 'mp4' then 'video' when 'jpg' then 'image' when 'png' then 'image' when 'tar.gz' then 'archive' when 'tar.bz2' then 'archive' when 'zip' then 'archive'
        when 'html' then 'text' when 'md' then 'text' when 'ts' then 'metadata_only' when 'apk' then 'metadata_only' when 'unknown' then null when 'zzz' then null else ext end as extractor from ({_NAMED})""")
def fallback_route(spark: SparkSession, d: str) -> DataFrame:
    routed = _named(spark, d).select("doc_id", detect.extension(F.col("path")).alias("ext"), detect.routed_type(F.col("path")).alias("routed"))
    return routed.withColumn("extractor", F.when(F.col("routed").isNotNull(), types.extractor_of(F.col("routed"))))


@query(f"""select case when ext in ('docx', 'docm', 'xls') then 'office' when ext = 'zip' then 'archive' when ext in ('jpg', 'png') then 'image' when ext = 'csv' then 'text' when ext = 'pdf' then 'pdf' else 'other' end as category, count(*) as n
    from ({_NAMED}) group by 1""")
def category_rollup(spark: SparkSession, d: str) -> DataFrame:
    return _named(spark, d).select(types.category_of(detect.extension(F.col("path"))).alias("category")).groupBy("category").agg(F.count("*").alias("n"))


@query(f"select doc_id, case ext when 'docx' then '打开Word文档失败' when 'xls' then '打开Excel文件失败' when 'pdf' then '打开PDF文件失败' else '打开文件失败' end || ': e' || doc_id as message, ext = 'jpg' or ext = 'docx' as same from ({_NAMED})")
def error_message(spark: SparkSession, d: str) -> DataFrame:
    ext = detect.extension(F.col("path"))
    other = F.when(ext == "jpg", "jpeg").when(ext == "docx", "dotx").otherwise("rar")
    return _named(spark, d).select("doc_id", detect.error_message(ext, F.concat(F.lit("e"), F.col("doc_id").cast("string"))).alias("message"), detect.same_type(ext, other).alias("same"))


_HEADS = ("D0CF11E0A1B11AE1", "504B030414000900", "504B030414000000", "377ABCAF271C0004", "25504446", "526172211A070100", "526172211A070000", "85", "8C01", "C4", "89504E47", "48656C6C6F")


def _headers(spark: SparkSession, d: str) -> DataFrame:
    head = F.get(F.array(*map(F.lit, _HEADS)), (F.col("doc_id") % len(_HEADS)).cast("int"))
    return table(spark, d, "documents").select("doc_id", F.unhex(F.concat(head, F.lit("2020202020"))).alias("c"))


_HEAD_SQL = "select doc_id, ['" + "','".join(_HEADS) + f"'][1 + doc_id % {len(_HEADS)}] || '2020202020' as h from documents"


@query(f"""select doc_id, case when h like 'D0CF11E0A1B11AE1%' then 'doc' when h like '504B0304%' then 'zip' when h like '526172211A07%' then 'rar' when h like '377ABCAF271C%' then '7z' when h like '25504446%' then 'pdf'
    when h like '85%' or h like '8C%' or h like 'C4%' then 'pgp' else '' end as sniffed,
    case when length(h) < 20 then '' when h like '504B0304%' then 'zip' when h like '25504446%' then 'pdf' when h like 'D0CF11E0A1B11AE1%' then 'doc' when h like '377ABCAF271C%' then '7z' when h like '52617221%' then 'rar' when h like '48656C%' then 'txt' else '' end as member
    from ({_HEAD_SQL})""")
def magic_sniff(spark: SparkSession, d: str) -> DataFrame:
    return _headers(spark, d).select("doc_id", detect.sniffed(F.col("c")).alias("sniffed"), detect.sniffed_member(F.col("c")).alias("member"))


@query(f"select doc_id, h like '504B030414000900%' as zip, false as rar, (h like '504B030414000900%' or h like '85%' or h like '8C%' or h like 'C4%') as encrypted from ({_HEAD_SQL})")
def encryption_flags(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("c")
    return _headers(spark, d).select("doc_id", encryption.zip_encrypted(c).alias("zip"), encryption.rar_encrypted(c).alias("rar"), encryption.encrypted(c, F.lit("zip")).alias("encrypted"))


@query("select doc_id, doc_id % 3 = 0 as encrypted from documents")
def pdf_keyword(spark: SparkSession, d: str) -> DataFrame:
    mark = F.when(F.col("doc_id") % 3 == 0, " /Encrypt 5 0 R ").otherwise("")
    c = F.encode(F.concat(F.lit("%PDF-1.4\n"), mark, F.coalesce("text", F.lit(""))), "UTF-8")
    return table(spark, d, "documents").select("doc_id", encryption.pdf_encrypted(c).alias("encrypted"))


@query("select doc_id, (doc_id % 4) in (1, 2) as encrypted from documents")
def rar4_flag(spark: SparkSession, d: str) -> DataFrame:
    """A file header block whose type and flags follow the id."""
    kind = F.get(F.array(*map(F.lit, ("00", "01", "02", "03"))), (F.col("doc_id") % 4).cast("int"))
    c = F.unhex(F.concat(F.lit("526172211A070000" + "00" * 30), kind, F.lit("00" + "01" + "00")))
    return table(spark, d, "documents").select("doc_id", encryption.rar_encrypted(c).alias("encrypted"))


_NEGATIVE = "(" + " or ".join(f"h like '{p}%'" for p in encryption.NOT_PGP) + ")"
_BYTE = "('0x' || substr(h, 1, 2))::int"
_PGP_SQL = f"""(length(h) >= 8 and case when {_NEGATIVE} then false when substr(h, 1, 2) in ('85', '8C', 'C4', 'A8', '84', '8D', '95', '99') then true
    when {_BYTE} >= 128 and {_BYTE} & 63 between 1 and 19 and not (substr(h, 3, 2) in ('50', '4A', '4D', '47') or substr(h, 3, 4) in ('8950', '8A4D', '8B4A', '8180', '5261', '377A')) then true
    else len(list_filter(range(0, 98), lambda i: substr(h, 2 * i + 1, 6) = '504750')) > 0 end)"""


@query(f"select doc_id, {_PGP_SQL} as encrypted from (select doc_id, hex(encode(coalesce(text, ''))) as h from documents)")
def pgp_heuristic(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", encryption.encrypted(_bytes(), F.lit("txt")).alias("encrypted"))


@query(f"select conv_id, turn, {_PGP_SQL} as encrypted from (select conv_id, turn, hex(encode(coalesce(text, ''))) as h from conversations)")
def pgp_heuristic_conversations(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select("conv_id", "turn", encryption.encrypted(_bytes(), F.lit("txt")).alias("encrypted"))


@query("""select doc_id, n > 0 and good * 10 >= n * 8 as printable from (select doc_id, length(h) // 2 as n,
    len(list_filter(range(0, length(h) // 2), lambda i: substr(h, 2 * i + 1, 2) between '20' and '7E' or substr(h, 2 * i + 1, 2) in ('09', '0A', '0D'))) as good
    from (select doc_id, substr(hex(encode(coalesce(text, ''))), 1, 2000) as h from documents))""")
def printable_ratio(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", detect.printable(_bytes()).alias("printable"))


# ---- text rules -----------------------------------------------------------------------------------------


@query("""select doc_id, case when s4 > greatest(s1, s2, s3) then '|' when s3 > greatest(s1, s2) then chr(9) when s2 > s1 then ';' else ',' end as sep from (select doc_id, length(t) - length(replace(t, ',', '')) as s1,
    length(t) - length(replace(t, ';', '')) as s2, length(t) - length(replace(t, chr(9), '')) as s3, length(t) - length(replace(t, '|', '')) as s4 from (select doc_id, coalesce(text, '') as t from documents))""")
def csv_separator(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.separator(F.coalesce("text", F.lit(""))).alias("sep"))


@query("select l_orderkey, l_linenumber, concat_ws(chr(9), l_orderkey, l_partkey, 'a \"q\" ' || l_returnflag, l_linestatus) || chr(10) || '1' || chr(9) || '2' as content from lineitem")
def csv_normalise(spark: SparkSession, d: str) -> DataFrame:
    sep = F.get(F.array(*map(F.lit, text.SEPARATORS)), (F.col("l_orderkey") % 4).cast("int"))
    quoted = F.concat(F.lit('"a ""q"" '), F.col("l_returnflag"), F.lit('"'))
    line = F.array_join(F.array(F.col("l_orderkey").cast("string"), F.col("l_partkey").cast("string"), quoted, F.col("l_linestatus")), "\x01")
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.encode(F.concat(F.replace(line, F.lit("\x01"), sep), F.lit("\n\n1"), sep, F.lit("2\n")), "UTF-8").alias("c"))
    return rows.select("l_orderkey", "l_linenumber", udfs.normalise_csv(F.col("c")).alias("content"))


@query("select page_id, array_to_string(regexp_extract_all(html, '(?s)<p>(.*?)</p>', 1), '') as content from pages")
def tag_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", text.tag_text(F.col("html"), "p").alias("content"))


@query("""select page_id, regexp_replace(regexp_replace(regexp_replace(replace(regexp_replace(html, '<[^>]*(>|$)', chr(1), 'g'), '>', ''), '(^|\\x01)[\\x01 \\t\\r\\n]*', '', 'g'), '[ \\t\\r\\n]+', ' ', 'g'), '^\\s+|\\s+$', '', 'g') as content from pages""")
def strip_tags(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", text.strip_tags(F.col("html")).alias("content"))


@query("select doc_id, '<' || coalesce(text, '') || '> & \"é\"' as content from documents")
def entities(spark: SparkSession, d: str) -> DataFrame:
    t = F.replace(F.coalesce("text", F.lit("")), F.lit("&"), F.lit("&amp;"))
    return table(spark, d, "documents").select("doc_id", udfs.unescape(F.concat(F.lit("&lt;"), t, F.lit("&gt; \\u0026 &quot;&#233;&quot;"))).alias("content"))


@query("select doc_id, '-----BEGIN PGP MESSAGE-----' || chr(10) || coalesce(text, '') || chr(10) || '-----END PGP MESSAGE-----' || chr(10) as content from documents")
def pgp_slice(spark: SparkSession, d: str) -> DataFrame:
    armor = F.concat(F.lit("before\n-----BEGIN PGP MESSAGE-----\n"), F.coalesce("text", F.lit("")), F.lit("\n-----END PGP MESSAGE-----\nafter"))
    return table(spark, d, "documents").select("doc_id", text.pgp_slice(armor).alias("content"))


@query("select doc_id, '中文' || chr(32) || doc_id::varchar as content from documents")
def utf8_gbk(spark: SparkSession, d: str) -> DataFrame:
    """The same text in UTF-8 or, every second one, in GBK."""
    raw = F.when(F.col("doc_id") % 2 == 0, F.encode(F.concat(F.lit("中文 "), F.col("doc_id").cast("string")), "UTF-8")).otherwise(F.concat(F.unhex(F.lit("D6D0CEC420")), F.encode(F.col("doc_id").cast("string"), "UTF-8")))
    return table(spark, d, "documents").select("doc_id", udfs.decode_text(raw).alias("content"))


@query("select doc_id, case when strlen(t) > 4096 then decode(encode(t)[1:4096]) || '...[truncated]' else t end as content from (select doc_id, regexp_replace(coalesce(text, ''), '[^\\x00-\\x7F]', '?', 'g') as t from documents)")
def log_truncate(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.truncate_log(F.regexp_replace(F.coalesce("text", F.lit("")), r"[^\x00-\x7F]", "?")).alias("content"))


@query("""select doc_id, case doc_id % 9 when 0 then 'docs/readme.txt' when 1 then 'a/b/c/file.go' when 2 then 'file.txt' when 8 then 'a/c' end as clean from documents""")
def slip_filter(spark: SparkSession, d: str) -> DataFrame:
    names = ("docs/readme.txt", "a/b/c/file.go", "./file.txt", "../etc/passwd", "a/b/c/d/../../../../../escape", "/etc/passwd", "C:\\Windows\\System32", ".", "a/b/../c")
    name = F.get(F.array(*map(F.lit, names)), (F.col("doc_id") % 9).cast("int"))
    return table(spark, d, "documents").select("doc_id", text.member_name(name).alias("clean"))


@query("select doc_id, case doc_id % 6 when 0 then '1,2,3,10' when 1 then '10' when 2 then '8' when 3 then '3,4,5' when 5 then '1' end as pages from documents")
def page_range(spark: SparkSession, d: str) -> DataFrame:
    spec = F.get(F.array(*map(F.lit, ("1-3,last,2", "last", "r2", "5-3,4", "11", "first"))), (F.col("doc_id") % 6).cast("int"))
    return table(spark, d, "documents").select("doc_id", F.array_join(text.page_range(spec, F.lit(10)), ",").alias("pages"))


@query("""select doc_id, '[file metadata]' || chr(10) || 'name: f' || doc_id || '.bin' || chr(10) || 'size: ' || strlen(t) || ' bytes' || chr(10) || 'type: application/x' || chr(10) || 'modified: 2024-01-02 03:04:05' || chr(10) || 'sha256: ' || sha256(t) || chr(10) as content
    from (select doc_id, coalesce(text, '') as t from documents)""")
def metadata_block(spark: SparkSession, d: str) -> DataFrame:
    c = _bytes()
    name = F.concat(F.lit("f"), F.col("doc_id").cast("string"), F.lit(".bin"))
    return table(spark, d, "documents").select("doc_id", text.metadata_block(name, F.lit("application/x"), F.length(c).cast("bigint"), F.lit("2024-01-02 03:04:05").cast("timestamp"), c).alias("content"))


@query("select doc_id, '/in/' || doc_id || ':123:' || strlen(t) || ':false:' || substr(sha1(encode(t)[1:65536]), 1, 16) as key from (select doc_id, coalesce(text, '') as t from documents)")
def cache_key(spark: SparkSession, d: str) -> DataFrame:
    c = _bytes()
    return table(spark, d, "documents").select("doc_id", text.cache_key(F.concat(F.lit("/in/"), F.col("doc_id").cast("string")), F.lit(123), F.length(c), F.lit(False), c).alias("key"))


@query("""select doc_id, case when strlen(t) = 0 then '[文件: m' || doc_id || ', 大小: 0 字节]' when good * 10 >= n * 8 then t else '[文件: m' || doc_id || ', 大小: ' || strlen(t) || ' 字节 (二进制或非文本文件)]' end as content from (select *, length(h) // 2 as n,
    len(list_filter(range(0, length(h) // 2), lambda i: substr(h, 2 * i + 1, 2) between '20' and '7E' or substr(h, 2 * i + 1, 2) in ('09', '0A', '0D'))) as good
    from (select doc_id, coalesce(text, '') as t, substr(hex(encode(coalesce(text, ''))), 1, 2000) as h from documents))""")
def member_fallback(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.member_fallback(F.concat(F.lit("m"), F.col("doc_id").cast("string")), _bytes()).alias("content"))


@query("select doc_id, sum(n_chars) over (partition by source order by doc_id rows between unbounded preceding and current row)::bigint as used, sum(n_chars) over (partition by source order by doc_id rows between unbounded preceding and current row) <= 1000000 as allowed from documents")
def budget_window(spark: SparkSession, d: str) -> DataFrame:
    """Running sums by source. Within blocks of ids first, then over the blocks' sums, so that no source is one task's rows."""
    docs = table(spark, d, "documents").select("source", "doc_id", "n_chars", F.floor(F.col("doc_id") / 4096).alias("block"))
    sums = docs.groupBy("source", "block").agg(F.sum("n_chars").alias("own"))
    before = F.coalesce(F.sum("own").over(Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sums.select(F.col("source").alias("s"), F.col("block").alias("b"), before.alias("before"))
    inside = F.sum("n_chars").over(Window.partitionBy("source", "block").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, 0))
    out = docs.withColumn("inside", inside).join(starts, F.col("source").eqNullSafe(F.col("s")) & F.col("block").eqNullSafe(F.col("b")))
    used = F.col("before") + F.col("inside")
    return out.select("doc_id", used.alias("used"), (used <= 1000000).alias("allowed"))


# ---- extraction -----------------------------------------------------------------------------------------

_RESULT_COLUMNS = ["file_name", "file_type", "file_size", "status", "content", "error_msg", "is_encrypt", "skipped"]


@query(f"""select 'doc' || doc_id || '.txt' as file_name, 'text/plain' as file_type, strlen(t)::bigint as file_size, case when e then 'failed' else 'success' end as status, case when e then '' else t end as content,
    case when e then '文件已加密，无法提取内容' else '' end as error_msg, e::int as is_encrypt, null::boolean as skipped from (select doc_id, t, {_PGP_SQL} as e from (select doc_id, coalesce(text, '') as t, hex(encode(coalesce(text, ''))) as h from documents))""")
def text_extract(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return X.extract(_files(docs, "txt", _bytes())).select(*_RESULT_COLUMNS)


def _round_trip(ext: str, sql: str, mode: str = "reference", status: str = "'success'", error: str | None = None, name: str = "") -> None:
    columns = ["file_name", "status", "content"] + ["error_msg"] * (error is not None)

    def run(spark: SparkSession, d: str) -> DataFrame:
        return X.extract(_files(table(spark, d, "documents"), ext), mode).select(columns)

    run.__name__ = name or ext.replace(".", "_") + "_round_trip"
    more = f", {error} as error_msg" if error is not None else ""
    query(f"select 'doc' || doc_id || '.{ext}' as file_name, {status} as status, {sql} as content{more} from (select doc_id, coalesce(text, '') as t from documents)")(run)


_TRIM = "regexp_replace(regexp_replace({}, '^[ \\t\\r\\n]+', ''), '[ \\t\\r\\n]+$', '')"
_TWO = "'=== a.txt ===' || chr(10) || t || chr(10) || chr(10) || '=== sub/b.txt ===' || chr(10) || 'second ' || t || chr(10) || chr(10)"
_WORDS = "regexp_replace(" + _TRIM.format("t") + ", '[ \\t\\r\\n]+', ' ', 'g')"
_round_trip("docx", "t || chr(10)")
_round_trip("docx", _TRIM.format("t"), "fixed", name="docx_fixed_round_trip")
_round_trip("odt", _WORDS)
_SLIDES = _TRIM.format("case when t = '' then '' else t || chr(10) end || 'end'")
_round_trip("pptx", _SLIDES, "fixed")
_round_trip("pptx", _SLIDES, name="pptx_reference_round_trip")
_round_trip("sheet.pptx", _TRIM.format("case when t = '' then '' else t || chr(10) end || 'cell 0 cell'"))
_FOUND = "case when " + _WORDS + " = '' then 'failed' else 'success' end"
_NO_CELLS = "case when " + _WORDS + " = '' then '未找到Excel内容' else '' end"
_round_trip("xlsx", _WORDS, "fixed", _FOUND, _NO_CELLS)
_round_trip("xlsx", f"replace(replace(replace({_WORDS}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')", "reference", _FOUND, _NO_CELLS, "xlsx_reference_round_trip")
_LINES = "array_to_string(list_filter(list_transform(string_split(t, chr(10)), lambda x: array_to_string(regexp_extract_all(x, '[^ \\t\\r]+'), ' ')), lambda x: x <> ''), chr(10))"
_round_trip("xls", _LINES, "fixed", f"case when {_LINES} = '' then 'failed' else 'success' end", f"case when {_LINES} = '' then '未找到Excel内容' else '' end")
_round_trip("doc", _TRIM.format("t"), "fixed")
_round_trip("ppt", _TRIM.format("t"), "fixed")
_round_trip("7z", "'=== f.txt ===' || chr(10) || 'seven ' || t || chr(10) || chr(10)", name="seven_zip_round_trip")
_round_trip("rar", "'=== f.txt ===' || chr(10) || 'rar ' || t || chr(10) || chr(10)")
_round_trip("iso", "'=== A.TXT ===' || chr(10) || '[ISO镜像信息]' || chr(10) || '卷标识: LABEL' || chr(10) || chr(10) || chr(10) || 'iso ' || t || chr(10) || chr(10)")
_RPM_TEXT = ["'[RPM包信息]'", "'名称: pkg'", "'版本: 1.0-2'", "'架构: noarch'", "'摘要: short'", "case when t <> '' then '描述: ' || t end", "'许可证: MIT'", "'构建时间: 1970-01-02 00:00:00 +0000 UTC'", "'大小: 12 字节'", "''", "'提供:'", "'  - pkg = 1.0-2'", "''", "'依赖:'", "'  - lib >= 3'", "'  - sh'", "''"]
_round_trip("rpm", "'=== doc' || doc_id || '.rpm ===' || chr(10) || concat_ws(chr(10), " + ", ".join(_RPM_TEXT) + ") || chr(10) || chr(10)")
_round_trip("xlsb", _WORDS)
_round_trip("rtf", "t")
_round_trip("zip", _TWO)
_round_trip("tar", _TWO)
_round_trip("tar.gz", _TWO)
_round_trip("tar.bz2", _TWO)
_round_trip("tar.xz", _TWO)
_HEX_1000 = "substr(hex(encode(t)), 1, 2000)"
_PRINTABLE = f"len(list_filter(regexp_extract_all({_HEX_1000}, '..'), lambda x: x between '20' and '7E' or x in ('09', '0A', '0D'))) * 20 >= length({_HEX_1000}) * 8"
for _kind in ("gz", "bz2", "xz"):
    _body = f"case when t = '' then '[{_kind.upper()}文件已解压，大小: 0 字节]' when {_PRINTABLE} then t else '[文件: doc' || doc_id || ', 大小: ' || strlen(t) || ' 字节 (二进制或非文本文件)]' end"
    _round_trip(_kind, f"'=== doc' || doc_id || ' ===' || chr(10) || {_body} || chr(10) || chr(10)")
_round_trip("nested.zip", _TWO + " || '=== inner.zip ===' || chr(10) || '[嵌套压缩包: 2 个文件]' || chr(10) || chr(10) || '=== top.txt ===' || chr(10) || t || chr(10) || chr(10)")
_round_trip("slip.zip", "'=== in.txt ===' || chr(10) || t || chr(10) || chr(10)")


@query("select 'doc' || doc_id || '.pdf' as file_name, 'success' as status, regexp_replace(regexp_replace(regexp_replace(t, chr(10) || '{2,}', chr(10), 'g'), '^\\s+', ''), '\\s+$', '') as content from (select doc_id, regexp_replace(coalesce(text, ''), '[^\\x0A\\x20-\\x7E]', '?', 'g') as t from documents)")
def pdf_round_trip(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").withColumn("text", F.regexp_replace(F.coalesce("text", F.lit("")), r"[^\x0A\x20-\x7E]", "?"))
    return X.extract(_files(docs, "pdf")).select("file_name", "status", "content")


@query("select 'doc' || doc_id || '.embedded.docx' as file_name, 'success' as status, " + "t || chr(10) || case when t = '' then '' else replace(replace(replace(array_to_string(regexp_extract_all(t, '[^ \\t\\r\\n]+'), ' '), '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || chr(10) end as content from (select doc_id, coalesce(text, '') as t from documents)")
def embedded_docx(spark: SparkSession, d: str) -> DataFrame:
    return X.extract(_files(table(spark, d, "documents"), "embedded.docx")).select("file_name", "status", "content")


@query("select '/in/doc' || doc_id || '.nested.zip' as path, unnest([0, 1, 2, 3])::int as pos, unnest([1, 1, 0, 0])::int as depth, unnest(['a.txt', 'sub/b.txt', 'inner.zip', 'top.txt']) as member_path, false as is_dir from documents")
def archive_members(spark: SparkSession, d: str) -> DataFrame:
    return X.members(_files(table(spark, d, "documents"), "nested.zip")).select("path", "pos", "depth", "member_path", "is_dir")


@query(f"""select status, is_encrypt, count(*) as n, sum(length(content))::bigint as chars from (select case when e then 'failed' else 'success' end as status, e::int as is_encrypt, case when e then '' else t end as content
    from (select t, {_PGP_SQL} as e from (select coalesce(text, '') as t, hex(encode(coalesce(text, ''))) as h from documents))) group by all""")
def status_rollup(spark: SparkSession, d: str) -> DataFrame:
    out = text_extract(spark, d)
    return out.groupBy("status", "is_encrypt").agg(F.count("*").alias("n"), F.sum(F.char_length("content")).alias("chars"))


@query("""select doc_id, case doc_id % 4 when 0 then 'success' when 1 then 'skipped' when 2 then 'skipped' else 'failed' end as status, case doc_id % 4 when 0 then '' when 1 then '' when 2 then '此文件类型已识别但无内容提取器，仅返回元数据' else '文件类型不支持' end as error_msg, case when doc_id % 4 = 1 then true end as skipped from documents""")
def route_status(spark: SparkSession, d: str) -> DataFrame:
    """Four kinds of files with plain contents: text, audio, recognised, unknown."""
    ext = F.get(F.array(*map(F.lit, ("txt", "mp3", "apk", "zzz"))), (F.col("doc_id") % 4).cast("int"))
    docs = table(spark, d, "documents").select("doc_id", F.concat(F.col("doc_id").cast("string"), F.lit("."), ext).alias("path"), F.lit("2024-01-02 03:04:05").cast("timestamp").alias("modificationTime"), F.lit(5).cast("bigint").alias("length"), F.encode(F.lit("hello"), "UTF-8").alias("content"))
    out = X.extract(docs).select("file_name", "status", "error_msg", "skipped")
    return out.select(F.regexp_extract("file_name", "^([0-9]+)", 1).cast("long").alias("doc_id"), "status", "error_msg", "skipped")


@query("""select '{"file_name":"d' || doc_id || '.mp3","file_type":"audio/mpeg","file_size":1,"status":"skipped","content":"","error_msg":"","is_encrypt":0,"skipped":true}' as json from documents""")
def result_json(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit(".mp3")).alias("path"), F.lit(None).cast("timestamp").alias("modificationTime"), F.lit(1).cast("bigint").alias("length"), F.encode(F.lit("x"), "UTF-8").alias("content"))
    return X.to_json(X.extract(docs).withColumn("execute_time", F.lit(None).cast("string")))


@query(f"""select quality, toxic, status, count(*) as n from (select doc_id, case when {_PGP_SQL} then 'failed' else 'success' end as status from (select doc_id, hex(encode(coalesce(text, ''))) as h from documents)) join labels using (doc_id) group by all""")
def label_join(spark: SparkSession, d: str) -> DataFrame:
    out = text_extract(spark, d).select(F.regexp_extract("file_name", "([0-9]+)", 1).cast("long").alias("doc_id"), "status")
    return out.join(table(spark, d, "labels"), "doc_id").groupBy("quality", "toxic", "status").agg(F.count("*").alias("n"))


@query("""select doc_id, (doc_id % 2 = 0)::int as is_encrypt, case when doc_id % 2 = 0 then 'failed' else 'success' end as status from documents where length(trim(coalesce(text, ''))) > 0""")
def ole_flags(spark: SparkSession, d: str) -> DataFrame:
    """Binary Word, Excel and PowerPoint files in turn, every second one with its format's mark of encryption."""
    kinds = (("doc", synthesise.doc), ("xls", synthesise.xls), ("ppt", synthesise.ppt))
    docs = table(spark, d, "documents").filter("length(trim(text)) > 0")
    build = udfs.scalar(lambda r: kinds[r["k"] % 3][1](r["t"], r["k"] % 2 == 0), "binary")
    content = build(F.struct(F.col("doc_id").alias("k"), F.col("text").alias("t")))
    ext = F.get(F.array(*[F.lit(k) for k, _ in kinds]), (F.col("doc_id") % 3).cast("int"))
    files = docs.select(F.concat(F.col("doc_id").cast("string"), F.lit("."), ext).alias("path"), F.lit(None).cast("timestamp").alias("modificationTime"), F.octet_length("text").cast("bigint").alias("length"), content.alias("content"))
    return X.extract(files, "fixed").select(F.regexp_extract("file_name", "^([0-9]+)", 1).cast("long").alias("doc_id"), "is_encrypt", "status")


@query("select doc_id, doc_id % 3 > 0 as encrypted, '7Z' as kind, '37' as first from documents")
def seven_zip_flag(spark: SparkSession, d: str) -> DataFrame:
    """Archives whose end header is plain, encoded, or names the AES method; the text is their data."""
    head = F.get(F.array(*map(F.lit, ("0104", "1706", "010406F10701"))), (F.col("doc_id") % 3).cast("int"))
    number = lambda n: F.reverse(F.lpad(F.hex(n), 16, "0"))
    little = lambda n: F.array_join(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.reverse(F.substring(number(n), 2 * i + 1, F.lit(2)))), "")
    body = F.hex(_bytes())
    c = F.unhex(F.concat(F.lit("377ABCAF271C0004" + "00" * 4), little(F.octet_length(F.coalesce("text", F.lit("")))), little(F.length(head) / 2), F.lit("00" * 4), body, head))
    found = encryption.info(F.lit("/a.7z"), c, F.lit("7z"))
    return table(spark, d, "documents").select("doc_id", found["is_encrypted"].alias("encrypted"), found["encryption_type"].alias("kind"), F.substring(found["header_hex"], 1, 2).alias("first"))


@query("select doc_id, 'success' as status, '[image: no OCR enabled, png, ' || (1 + strlen(t)) || 'x' || (1 + doc_id) || ']' as content from (select doc_id, coalesce(text, '') as t from documents)")
def image_note(spark: SparkSession, d: str) -> DataFrame:
    build = udfs.scalar(lambda r: synthesise.png(1 + len(r["t"].encode()), 1 + r["k"]), "binary")
    files = _files(table(spark, d, "documents"), "png", build(F.struct(F.col("doc_id").alias("k"), F.coalesce("text", F.lit("")).alias("t"))))
    return X.extract(files).select(F.regexp_extract("file_name", "([0-9]+)", 1).cast("long").alias("doc_id"), "status", "content")


@query("""select c_custkey, printf('%.2f%%', c_acctbal * 100) || ' ' || printf('%.2f', c_acctbal) || ' ' || printf('%.0f', c_acctbal) || ' ' || regexp_replace(c_acctbal::varchar, '[.]0$', '') || ' ' || regexp_replace(c_acctbal::varchar, '[.]0$', '')
    || ' ' || month(d) || '/' || day(d) || '/' || strftime(d, '%y') || ' ' || strftime(d, '%m/%d/%Y') || ' 06:00:00' as content from (select c_custkey, c_acctbal, date '1899-12-30' + (40000 + c_custkey % 5000)::int as d from customer)""")
def xls_numbers(spark: SparkSession, d: str) -> DataFrame:
    """A balance in percent, two places, whole, General and built-in format, and a day in two date formats.

    A customer is a few bytes and its workbook 5,632, so the scan's tasks, cut by bytes, are too few: the customers are dealt to all cores.
    """
    formats = ["0.00%", "#,##0.00", "0", "General", "", "M/D/YY", "MM/DD/YYYY\\ HH:MM:SS"]
    build = udfs.scalar(lambda r: synthesise.xls_numbers(formats, [r["x"]] * 5 + [r["day"], r["day"] + 0.25]), "binary")
    dealt = table(spark, d, "customer").select("c_custkey", "c_acctbal").repartition(4 * spark.sparkContext.defaultParallelism)
    rows = dealt.select("c_custkey", build(F.struct(F.col("c_acctbal").alias("x"), (40000.0 + F.col("c_custkey") % 5000).alias("day"))).alias("content"))
    files = rows.select(F.concat(F.col("c_custkey").cast("string"), F.lit(".xls")).alias("path"), F.lit(None).cast("timestamp").alias("modificationTime"), F.length("content").cast("bigint").alias("length"), "content")
    return X.extract(files).select(F.regexp_extract("file_name", "^([0-9]+)", 1).cast("long").alias("c_custkey"), "content")


@query("""select doc_id, 'a' || t || 'b-c*d' || chr(34) || 'e' || chr(34) || ' f' || chr(10) || 'g' as content, 'a' || t || 'b' || chr(8212) || 'c' || chr(8226) || 'd' || chr(8220) || 'e' || chr(8221) || '|f' || chr(10) || chr(10) || 'g' as signs
    from (select doc_id, regexp_replace(coalesce(text, ''), '[^A-Za-z0-9 ]', '', 'g') as t from documents)""")
def rtf_symbols(spark: SparkSession, d: str) -> DataFrame:
    t = F.regexp_replace(F.coalesce("text", F.lit("")), "[^A-Za-z0-9 ]", "")
    raw = F.encode(F.concat(F.lit("{\\rtf1 a"), t, F.lit("b\\emdash c\\bullet d\\ldblquote e\\rdblquote\\cell f\\sect g}")), "UTF-8")
    return table(spark, d, "documents").select("doc_id", udfs.rtf_text(raw).alias("content"), udfs.rtf_text_fixed(raw).alias("signs"))


@query("select doc_id, regexp_replace(coalesce(text, ''), '[\\x{10000}-\\x{10FFFF}]', chr(65533) || chr(65533), 'g') as content from documents")
def utf16_units(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", udfs.utf16_units(F.encode(F.coalesce("text", F.lit("")), "UTF-16LE")).alias("content"))


@query("select doc_id, '-----BEGIN PGP MESSAGE-----' || chr(10) || coalesce(text, '') as content, substr(coalesce(text, ''), 1, 1048576) as bare from documents where not contains(coalesce(text, ''), '-----')")
def pgp_open_armor(spark: SparkSession, d: str) -> DataFrame:
    """Armor that never ends is kept to the end of the text."""
    t = F.coalesce("text", F.lit(""))
    rows = table(spark, d, "documents").filter(~F.contains(t, F.lit("-----")))
    return rows.select("doc_id", text.pgp_slice(F.concat(F.lit("before\n-----BEGIN PGP MESSAGE-----\n"), t)).alias("content"), text.pgp_slice(t).alias("bare"))


@query(f"select doc_id, ext in ('docx', 'docm', 'xls') as office, ext = 'zip' as archive, ext in ('jpg', 'png') as image, ext = 'csv' as plain from ({_NAMED})")
def type_predicates(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("path")
    return _named(spark, d).select("doc_id", detect.is_office(p).alias("office"), detect.is_archive(p).alias("archive"), detect.is_image(p).alias("image"), detect.is_text(p).alias("plain"))


@query("select doc_id, array_to_string(list_transform(regexp_extract_all(coalesce(text, ''), '[^ \\t\\r\\n]+'), lambda w: regexp_full_match(w, '[0-9]+')::int::varchar), '') as numbers from documents")
def pure_numbers(spark: SparkSession, d: str) -> DataFrame:
    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("[^ \\t\\r\\n]+"), F.lit(0))
    return table(spark, d, "documents").select("doc_id", F.array_join(F.transform(words, lambda w: text.is_number(w).cast("int").cast("string")), "").alias("numbers"))


@query("select doc_id, case doc_id % 4 when 0 then 'docx' when 1 then 'xlsx' when 2 then 'pptx' else 'odt' end as kind from documents")
def zip_kind(spark: SparkSession, d: str) -> DataFrame:
    """What a zip container holds, by its entries."""
    kinds = ("docx", "xlsx", "pptx", "odt")
    build = udfs.scalar(lambda r: office.kind_of(synthesise.BUILDERS[kinds[r["k"] % 4]](r["t"])), "string")
    return table(spark, d, "documents").select("doc_id", build(F.struct(F.col("doc_id").alias("k"), F.coalesce("text", F.lit("")).alias("t"))).alias("kind"))


# ---- model ----------------------------------------------------------------------------------------------


@query("""select doc_id, len(f) as n, list_sum(list_transform(range(1, 2049), lambda i: f[i] * (i % 97)))::bigint as checksum from (select doc_id, list_concat(list_transform(range(0, 1024), lambda i: case when 2 * i < length(b) then ('0x' || substr(b, 2 * i + 1, 2))::int else 256 end),
    list_transform(range(0, 1024), lambda i: case when 2 * (1024 - i) <= length(e) then ('0x' || substr(e, length(e) - 2 * (1024 - i) + 1, 2))::int else 256 end)) as f
    from (select doc_id, regexp_replace(substr(h, 1, 8192), '^(20|09|0A|0D|0B|0C)+', '') as b, regexp_replace(case when length(h) > 8192 then right(h, 8192) else h end, '^((..)*?)((20|09|0A|0D|0B|0C)*)$', '\\1') as e from (select doc_id, hex(encode(coalesce(text, ''))) as h from documents)))""")
def model_features(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "documents").select("doc_id", model.features_column(_bytes()).alias("f"))
    return f.select("doc_id", F.size("f").alias("n"), F.aggregate(F.transform("f", lambda x, i: (x * ((i + 1) % 97)).cast("bigint")), F.lit(0).cast("bigint"), lambda a, x: a + x).alias("checksum"))


@query("""select vec_id, case when m >= 0.25 then 'l' || (p - 1) when (p - 1) % 2 = 0 then 'txt' else 'unknown' end as label from (select vec_id, list_max(embedding) as m, list_position(embedding, list_max(embedding)) as p from embeddings)""")
def argmax_threshold(spark: SparkSession, d: str) -> DataFrame:
    labels = [f"l{i}" for i in range(64)]
    return table(spark, d, "embeddings").select("vec_id", model.decided(F.col("embedding"), labels, {}, {x: i % 2 == 0 for i, x in enumerate(labels)}, 0.25).alias("label"))


@query("""select doc_id, case when k = 0 then 'jpg' when k = 1 then 'txt' when k = 2 then 'mid' when k = 3 then 'wav' when k = 4 then 'unknown' when w is null then 'python' else w end as type from (select doc_id, doc_id % 6 as k, nullif(regexp_extract(coalesce(text, ''), '[^ \\t\\r\\n]+'), '') as w from documents)""")
def label_types(spark: SparkSession, d: str) -> DataFrame:
    """Types of content labels; a label without a type of its own takes its first extension, here the text's first word."""
    label = F.get(F.array(*map(F.lit, ("jpeg", "textproto", "midi", "wav", "unknown", "python"))), (F.col("doc_id") % 6).cast("int"))
    word = F.regexp_extract(F.coalesce("text", F.lit("")), "[^ \\t\\r\\n]+", 0)
    return table(spark, d, "documents").select("doc_id", model.label_type(label, F.filter(F.array(word), lambda w: w != "")).alias("type"))


@query("""select doc_id, case when t = '' then 'empty' when strlen(regexp_replace(t, '^[ \\t\\r\\n]+|[ \\t\\r\\n]+$', '', 'g')) < 8 then 'txt' end as whole,
    array_to_string(list_transform(regexp_extract_all(t, '[^ \\t\\r\\n]+'), lambda w: case when strlen(w) < 8 then 'txt' else '-' end), ' ') as words from (select doc_id, coalesce(text, '') as t from documents)""")
def short_labels(spark: SparkSession, d: str) -> DataFrame:
    """Labels of what is too short for the model: of texts and of each of their words."""
    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("[^ \\t\\r\\n]+"), F.lit(0))
    return table(spark, d, "documents").select("doc_id", model.small_label(_bytes()).alias("whole"), F.array_join(F.transform(words, lambda w: F.coalesce(model.small_label(F.encode(w, "UTF-8")), F.lit("-"))), " ").alias("words"))
