"""The library's own queries over the given tables, and the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexquarry.functions import content as C
from lexquarry.functions import paths as P
from lexquarry.functions.weights import WeightTable
from lexquarry.operators import bigrams, index, quotas, scan, segments
from lexquarry.operators import lines as L
from lexquarry.operators.search import SearchOptions, search
from lexquarry.sources import store
from lexquarry.streaming import maintain

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register(name: str, f: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    QUERIES[name] = f
    if sql:
        SQL[name] = sql


# ---------------------------------------------------------------- search
def lines_sql(name: str = "documents", key: str = "doc_id", text: str = "text") -> str:
    return f"""(SELECT {key}, unnest(range(1, len(ls) + 1))::INT AS line_no, unnest(ls) AS line FROM (
  SELECT {key}, CASE WHEN {text} IS NULL OR {text} = '' THEN [] WHEN suffix({text}, chr(10)) THEN list_slice(string_split({text}, chr(10)), 1, len(string_split({text}, chr(10))) - 1)
    ELSE string_split({text}, chr(10)) END AS ls FROM {name}))"""


LINES = lines_sql()
PHONE, THE_OF, VERSION = r"[0-9]{3}-[0-9]{4}", "the .* of", r"[0-9]+\.[0-9]+\.[0-9]+"


def grep(name: str, options: SearchOptions, sql: str | None, source: str = "documents", key: str = "doc_id", text: str = "text") -> None:
    register(name, lambda spark, d: search(table(spark, d, source), options, key, text), sql)


def _files(p: str, opts: str = "", hit: str | None = None) -> str:
    cond = hit or f"regexp_matches(line, '{p}'{opts})"
    return f"SELECT DISTINCT doc_id FROM {LINES} WHERE {cond}"


S = SearchOptions
grep("grep_files_with_matches", S("license", mode="files_with_matches"), _files("license"))
grep("grep_files_without_match", S(PHONE, mode="files_without_match"), f"SELECT doc_id FROM documents EXCEPT ({_files(PHONE)})")
grep("grep_quiet", S("zzqx", mode="quiet"), f"SELECT count(*) > 0 AS found FROM {LINES} WHERE regexp_matches(line, 'zzqx')")
grep("grep_lines", S(PHONE), f"SELECT doc_id, line_no, line FROM {LINES} WHERE regexp_matches(line, '{PHONE}')")
grep("grep_invert", S("[a-z]", invert=True), f"SELECT doc_id, line_no, line FROM {LINES} WHERE NOT regexp_matches(line, '[a-z]')")
grep("grep_invert_files", S("e", invert=True, mode="files_with_matches"), _files("", hit="NOT regexp_matches(line, 'e')"))
grep("grep_passthru", S("license", mode="passthru"), f"SELECT doc_id, line_no, regexp_matches(line, 'license') AS is_match, line FROM {LINES}")
grep("grep_count", S(THE_OF, mode="count"), f"SELECT doc_id, count(*) AS n FROM {LINES} WHERE regexp_matches(line, '{THE_OF}') GROUP BY doc_id")
grep("grep_count_matches", S("[0-9]+", mode="count_matches"), f"SELECT doc_id, sum(len(regexp_extract_all(line, '[0-9]+')))::BIGINT AS n FROM {LINES} GROUP BY doc_id HAVING n > 0")
grep("grep_count_invert", S("the", mode="count", invert=True), f"SELECT doc_id, count(*) AS n FROM {LINES} WHERE NOT regexp_matches(line, 'the') GROUP BY doc_id")
grep("grep_include_zero", S("nicht", mode="count", include_zero=True), f"SELECT d.doc_id, coalesce(n, 0) AS n FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS n FROM {LINES} WHERE regexp_matches(line, 'nicht') GROUP BY doc_id) c USING (doc_id)")
grep("grep_stats", S("[0-9]+", mode="stats"), f"""SELECT (SELECT sum(len(regexp_extract_all(line, '[0-9]+')))::BIGINT FROM {LINES}) AS matches, (SELECT count(*) FROM {LINES} WHERE regexp_matches(line, '[0-9]+')) AS matched_lines,
  (SELECT count(DISTINCT doc_id) FROM {LINES} WHERE regexp_matches(line, '[0-9]+')) AS files_with_match, (SELECT count(*) FROM documents) AS files_searched, (SELECT sum(strlen(text))::BIGINT FROM documents) AS bytes_searched""")
_EACH = f"SELECT doc_id, line_no, unnest(regexp_extract_all(line, '[0-9]+')) AS m FROM {LINES}"
register("grep_only_matching", lambda s, d: search(table(s, d, "documents"), S("[0-9]+", mode="only_matching")).select("doc_id", "line_no", F.col("match").alias("m")), _EACH)
grep("grep_replace", S(r"([0-9]{3})-(?P<last>[0-9]{4})", replace="<$2:${last}:$1$$>"), f"SELECT doc_id, line_no, regexp_replace(line, '([0-9]{{3}})-([0-9]{{4}})', '<\\2:\\2:\\1$>', 'g') AS line FROM {LINES} WHERE regexp_matches(line, '{PHONE}')")
# places of matches: what lies before the n-th one is the line without it and what follows
_AT = f"""SELECT doc_id, line_no, (1 + strlen(array_to_string(list_slice(gaps, 1, i), '')) + coalesce(strlen(array_to_string(list_slice(ms, 1, i - 1), '')), 0))::BIGINT AS col, line FROM (
  SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM (SELECT doc_id, line_no, line, regexp_extract_all(line, '[0-9]+') AS ms, regexp_split_to_array(line, '[0-9]+') AS gaps FROM {LINES}) WHERE len(ms) > 0)"""
grep("grep_vimgrep", S("[0-9]+", mode="vimgrep"), _AT)
register("grep_column", lambda s, d: search(table(s, d, "documents"), S("[0-9]+", column=True)).select("doc_id", "line_no", "col"), f"SELECT doc_id, line_no, min(col) AS col FROM ({_AT}) GROUP BY ALL")
register("grep_byte_offset", lambda s, d: search(table(s, d, "documents"), S(PHONE, byte_offset=True)).select("doc_id", "line_no", "byte_offset"),
    f"SELECT doc_id, line_no, byte_offset FROM (SELECT *, coalesce(sum(strlen(line) + 1) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS byte_offset FROM {LINES}) WHERE regexp_matches(line, '{PHONE}')")
grep("grep_max_columns", S("license", max_columns=60), f"SELECT doc_id, line_no, CASE WHEN strlen(line) > 60 THEN '[Omitted long matching line]' ELSE line END AS line FROM {LINES} WHERE regexp_matches(line, 'license')")
grep("grep_max_columns_preview", S("license", max_columns=40, max_columns_preview=True, trim=True), f"SELECT doc_id, line_no, CASE WHEN strlen(l) > 40 THEN substr(l, 1, 40) || ' [... omitted end of long line]' ELSE l END AS line FROM (SELECT *, ltrim(line, ' ' || chr(9)) AS l FROM {LINES}) WHERE regexp_matches(line, 'license')")
_CTX = """SELECT doc_id, line_no, is_match, sum(gap) OVER (PARTITION BY doc_id ORDER BY line_no)::INT AS block, line FROM (
  SELECT *, CASE WHEN line_no - lag(line_no) OVER (PARTITION BY doc_id ORDER BY line_no) = 1 THEN 0 ELSE 1 END AS gap FROM (
    SELECT *, max(is_match::INT) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN {a} PRECEDING AND {b} FOLLOWING) AS near FROM (
      SELECT doc_id, line_no, line, regexp_matches(line, '{p}') AS is_match FROM """ + LINES + """)) WHERE near = 1)"""  # fmt: skip
for _n, _b, _a in (("grep_context_after", 0, 2), ("grep_context_before", 1, 0), ("grep_context", 2, 2)):
    grep(_n, S(PHONE, before=_b, after=_a), _CTX.replace("{a}", str(_a)).replace("{b}", str(_b)).replace("{p}", PHONE))
grep("grep_max_count", S("the", max_count=2), f"SELECT doc_id, line_no, line FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS r FROM {LINES} WHERE regexp_matches(line, 'the')) WHERE r <= 2")
grep("grep_stop_on_nonmatch", S("e", stop_on_nonmatch=True), f"""WITH l AS (SELECT *, regexp_matches(line, 'e') AS hit FROM {LINES}), f AS (SELECT doc_id, min(line_no) AS first FROM l WHERE hit GROUP BY doc_id),
  e AS (SELECT doc_id, min(line_no) AS stop FROM l JOIN f USING (doc_id) WHERE NOT hit AND line_no > first GROUP BY doc_id)
  SELECT doc_id, line_no, line FROM l LEFT JOIN e USING (doc_id) WHERE hit AND (stop IS NULL OR line_no < stop)""")  # fmt: skip
grep("grep_fixed", S("(c)", fixed=True), f"SELECT doc_id, line_no, line FROM {LINES} WHERE contains(line, '(c)')")
grep("grep_fixed_dot", S("e. ", fixed=True, mode="count"), f"SELECT doc_id, count(*) AS n FROM {LINES} WHERE contains(line, 'e. ') GROUP BY doc_id")
grep("grep_multi_pattern", S(("license", "thble", PHONE), mode="files_with_matches"), _files(f"license|thble|{PHONE}"))
grep("grep_ignore_case", S("LICENSE", ignore_case=True, mode="files_with_matches"), _files("license", ", 'i'"))
grep("grep_smart_case", S("license", smart_case=True, mode="files_with_matches"), _files("license", ", 'i'"))
grep("grep_smart_case_upper", S("License", smart_case=True, mode="files_with_matches"), _files("License"))
grep("grep_inline_case", S("(?i:LIC)ense", mode="files_with_matches"), _files("[lL][iI][cC]ense"))
grep("grep_word", S("nicht", word=True, mode="count"), f"SELECT doc_id, count(*) AS n FROM {LINES} WHERE regexp_matches(line, '(^|[^\\pL\\pM\\pN_])nicht([^\\pL\\pM\\pN_]|$)') GROUP BY doc_id")
grep("grep_line_regexp", S("[A-Z][^.]*[.]", whole_line=True, mode="count"), f"SELECT doc_id, count(*) AS n FROM {LINES} WHERE regexp_full_match(line, '[A-Z][^.]*[.]') GROUP BY doc_id")
grep("grep_crlf", S("[a-z]$", crlf=True, mode="count"), f"SELECT doc_id, count(*) AS n FROM {LINES} WHERE regexp_matches(rtrim(line, chr(13)), '[a-z]$') GROUP BY doc_id")
grep("grep_multiline", S(r"[a-z]\n[A-Z]", multiline=True, mode="count_matches"), r"SELECT doc_id, len(regexp_extract_all(text, '[a-z]\n[A-Z]')) AS n FROM documents WHERE regexp_matches(text, '[a-z]\n[A-Z]')")
grep("grep_multiline_dotall", S(r"license.*nicht", multiline=True, dotall=True, mode="files_with_matches"), "SELECT doc_id FROM documents WHERE regexp_matches(text, 'license.*nicht', 's')")
grep("grep_anchor_start", S("^The ", mode="count"), f"SELECT doc_id, count(*) AS n FROM {LINES} WHERE starts_with(line, 'The ') GROUP BY doc_id")
grep("grep_anchor_end", S(r"[a-z]\.$", mode="count"), f"SELECT doc_id, count(*) AS n FROM {LINES} WHERE regexp_matches(line, '[a-z]\\.$') GROUP BY doc_id")
grep("grep_unicode_class", S(r"\p{Lu}\p{Ll}+ß", mode="count_matches"), f"SELECT doc_id, sum(len(regexp_extract_all(line, '\\p{{Lu}}\\p{{Ll}}+ß')))::BIGINT AS n FROM {LINES} GROUP BY doc_id HAVING n > 0")
grep("grep_no_unicode", S(r"\w+@\w+", unicode=False, mode="count_matches"), f"SELECT doc_id, sum(len(regexp_extract_all(line, '[0-9A-Za-z_]+@[0-9A-Za-z_]+')))::BIGINT AS n FROM {LINES} GROUP BY doc_id HAVING n > 0")
grep("grep_json", S("zzqx|license", mode="json"), f"SELECT to_json({{'type': 'match', 'data': {{'path': doc_id, 'line_number': line_no, 'lines': {{'text': line}}}}}})::VARCHAR AS message FROM {LINES} WHERE regexp_matches(line, 'license')")
grep("html_grep_pages", S("<h[1-6][^>]*>", mode="count_matches"), f"SELECT page_id, sum(len(regexp_extract_all(line, '<h[1-6][^>]*>')))::BIGINT AS n FROM {lines_sql('pages', 'page_id', 'html')} GROUP BY page_id HAVING n > 0", "pages", "page_id", "html")
register("chat_grep_conversations", lambda s, d: table(s, d, "conversations").where(L.any_line_matches(F.col("text"), S("(?i)please|bitte").java())).groupBy("role").agg(F.count("*").alias("n")),
    "SELECT role, count(*) AS n FROM conversations WHERE regexp_matches(text, 'please|bitte', 'i') GROUP BY role")
grep("benchmark_contains", S("the", fixed=True, mode="count"), f"SELECT item_id, count(*) AS n FROM {lines_sql('benchmark', 'item_id')} WHERE contains(line, 'the') GROUP BY item_id", "benchmark", "item_id")


# ---------------------------------------------------------------- sources, paths, sorts
def _page_paths(spark, d):
    return table(spark, d, "pages").select("page_id", F.regexp_replace("url", F.lit("^[a-z]+://"), F.lit("")).alias("path"), F.octet_length("html").alias("length"))


_PATHS = "(SELECT page_id, regexp_replace(url, '^[a-z]+://', '') AS path, strlen(html) AS length FROM pages)"
register("glob_paths", lambda s, d: _page_paths(s, d).where(P.glob_filter(F.col("path"), ["**/*1*", "!*12*"])).select("page_id"), f"SELECT page_id FROM {_PATHS} WHERE regexp_matches(path, '(^|/)[^/]*1[^/]*(/.*)?$') AND NOT regexp_matches(path, '(^|/)[^/]*12[^/]*(/.*)?$')")
register("root_restrict", lambda s, d: _page_paths(s, d).where(P.under(F.col("path"), "example.com") | (P.depth(F.col("path")) > 2)).select("page_id"), f"SELECT page_id FROM {_PATHS} WHERE path = 'example.com' OR starts_with(path, 'example.com/') OR len(string_split(path, '/')) > 2")
register("sort_by_path", lambda s, d: quotas.running_sum(_page_paths(s, d), F.lit(1), "r", [P.path_order(F.col("path")), F.col("page_id")]).select("page_id", "r"), f"SELECT page_id, row_number() OVER (ORDER BY string_split(path, '/'), page_id) AS r FROM {_PATHS}")
register("ext_bytes", lambda s, d: bigrams.bytes_by_extension(_page_paths(s, d)), f"SELECT lower(regexp_extract(string_split(path, '/')[-1], '^.+\\.([^.]+)$', 1)) AS extension, sum(length)::BIGINT AS bytes, count(*) AS files FROM {_PATHS} GROUP BY 1")
register("max_filesize", lambda s, d: _page_paths(s, d).where(F.col("length") <= 4000).select("page_id"), f"SELECT page_id FROM {_PATHS} WHERE length <= 4000")
register("nearest_root", lambda s, d: maintain.nearest_root(_page_paths(s, d).select("path").distinct(), _page_paths(s, d).select(F.substring_index("path", "/", 1).alias("root")).distinct()), f"SELECT DISTINCT path, string_split(path, '/')[1] AS root FROM {_PATHS}")


# ---------------------------------------------------------------- content and summaries
_SUMMARY = ["byte_len", "line_count", "empty_lines", "longest_line"]


def _scanned(spark, d, name="documents", key="doc_id", text="text"):
    """Facts that need no grams."""
    return scan.scan(table(spark, d, name), None, key, text, grams=False)


_LINE_FACTS = f"SELECT doc_id, count(*)::INT AS line_count, count(*) FILTER (WHERE line = '')::INT AS empty_lines, max(strlen(line))::INT AS longest_line FROM {LINES} GROUP BY doc_id"
register("summary_facts", lambda s, d: _scanned(s, d).where("status = 2").select("doc_id", *_SUMMARY), f"SELECT doc_id, strlen(text)::BIGINT AS byte_len, line_count, empty_lines, longest_line FROM documents JOIN ({_LINE_FACTS}) USING (doc_id) WHERE text <> ''")
register("class_flags", lambda s, d: _scanned(s, d).where("status = 2").select("doc_id", *[(F.col("flags").bitwiseAND(bit) != 0).alias(n) for n, bit in (("lf", scan.LF), ("upper", scan.UPPER), ("lower", scan.LOWER), ("digit", scan.DIGIT), ("space", scan.SPACE), ("non_ascii", scan.NON_ASCII), ("ends_lf", scan.ENDS_LF))]),
    r"SELECT doc_id, contains(text, chr(10)) AS lf, regexp_matches(text, '[A-Z]') AS upper, regexp_matches(text, '[a-z]') AS lower, regexp_matches(text, '[0-9]') AS digit, regexp_matches(text, '\s') AS space, regexp_matches(text, '[^\x00-\x7F]') AS non_ascii, suffix(text, chr(10)) AS ends_lf FROM documents WHERE text <> ''")
register("edge_bytes", lambda s, d: _scanned(s, d).where("status = 2").select("doc_id", F.hex("prefix").alias("prefix"), F.hex("suffix").alias("suffix")), "SELECT doc_id, substr(h, 1, 32) AS prefix, CASE WHEN length(h) > 32 THEN right(h, 32) ELSE h END AS suffix FROM (SELECT doc_id, hex(encode(text)) AS h FROM documents WHERE text <> '')")
register("byte_histogram", lambda s, d: _scanned(s, d).where("status = 2").select("doc_id", scan.byte_count("counts", 101).cast("long").alias("e"), scan.byte_count("counts", 32).cast("long").alias("blank"), scan.byte_count("counts", 195).cast("long").alias("c3")),
    "SELECT doc_id, least(length(text) - length(replace(text, 'e', '')), 255)::BIGINT AS e, least(length(text) - length(replace(text, ' ', '')), 255)::BIGINT AS blank, least(len(regexp_extract_all(text, '[À-ÿ]')), 255)::BIGINT AS c3 FROM documents WHERE text <> ''")
register("need_min_len", lambda s, d: _scanned(s, d).where("status = 2 and byte_len >= 500 and longest_line >= 200").select("doc_id"), f"SELECT doc_id FROM documents JOIN ({_LINE_FACTS}) USING (doc_id) WHERE strlen(text) >= 500 AND longest_line >= 200")
register("need_line_edges", lambda s, d: _scanned(s, d).where(F.col("status") == 2).where(scan.bit_set("line_start", ord("T")) & scan.bit_set("line_end", ord("."))).select("doc_id"), f"SELECT doc_id FROM {LINES} GROUP BY doc_id HAVING bool_or(starts_with(line, 'T')) AND bool_or(suffix(line, '.'))")
register("summary_totals", lambda s, d: _scanned(s, d).agg(F.sum((F.col("status") == 2).cast("long")).alias("texts"), F.sum("byte_len").cast("long").alias("bytes"), F.sum(((F.col("status") == 2) & (scan.byte_count("counts", 64) > 0)).cast("long")).alias("with_at")), "SELECT count(*) FILTER (WHERE text <> '') AS texts, sum(strlen(text))::BIGINT AS bytes, count(*) FILTER (WHERE contains(text, '@')) AS with_at FROM documents")


def _bytes_frame(spark, d):
    """Texts made into files of all kinds: as they are, with marks, NULs, control bytes and signatures before them."""
    kinds = F.pmod("doc_id", F.lit(6))
    head = F.element_at(F.array(*[F.lit(bytearray(x)) for x in (b"", b"\xef\xbb\xbf", b"\xff\xfe", b"\x7fELF", b"ab\0", b"\1\2\3\4\5\6\7\x08\x0e\x0f")]), (kinds + 1).cast("int"))
    return table(spark, d, "documents").select("doc_id", F.concat(head, F.encode("text", "UTF-8")).alias("content"))


_BYTES = "(SELECT doc_id, ['', 'EFBBBF', 'FFFE', '7F454C46', '616200', '01020304050607080E0F'][doc_id % 6 + 1] AS head, hex(encode(text)) AS body FROM documents)"
register("binary_sniff", lambda s, d: _bytes_frame(s, d).select("doc_id", C.signature_column(F.col("content")).alias("signature"), C.decoding_bom_column(F.col("content")).alias("marked"), (C.nul_position(F.col("content")) > 0).alias("nul")),
    f"SELECT doc_id, (head = '7F454C46' OR (head = '' AND (regexp_matches(body, '^(424D|4D5A|494433|4F5243|50415231|52494646|53504E47|4F676753|664C6143|25504446|425A68)')))) AS signature, head = 'FFFE' AS marked, head = '616200' AS nul FROM {_BYTES}")
register("bom_strip", lambda s, d: _bytes_frame(s, d).select("doc_id", F.octet_length(C.without_bom_column(F.col("content"))).cast("long").alias("n")), f"SELECT doc_id, (length(head || body) / 2 - CASE WHEN head = 'EFBBBF' THEN 3 ELSE 0 END)::BIGINT AS n FROM {_BYTES}")
register("nul_prefix", lambda s, d: _bytes_frame(s, d).select("doc_id", F.octet_length(C.searchable_prefix_column(F.col("content"))).cast("long").alias("n")), f"SELECT doc_id, CASE WHEN head = '616200' THEN 2 ELSE (length(head || body) / 2)::BIGINT END AS n FROM {_BYTES}")
register("control_bytes", lambda s, d: _bytes_frame(s, d).select("doc_id", C.likely_binary_column(F.col("content")).alias("binary")), f"SELECT doc_id, (least(length(head || body) // 2, 8192) >= 10 AND CASE head WHEN '01020304050607080E0F' THEN 10 WHEN '616200' THEN 1 ELSE 0 END > least(length(head || body) // 2, 8192) // 10) AS binary FROM {_BYTES}")


def _classified(spark, d):
    out = scan.scan(_bytes_frame(spark, d), WeightTable.synthetic(), "doc_id", "content", grams=False)
    return out.groupBy("status", "forced").agg(F.count("*").alias("n"), F.sum(F.col("held").isNotNull().cast("long")).alias("held"))


register("classify_content", _classified)


# ---------------------------------------------------------------- grams
def _sql_weight(a: int, b: int) -> int:
    return ((a * 31 + b * 17 + 7) * 2654435761) % (1 << 32)


_SQL_TABLE = WeightTable.from_function(_sql_weight)
_HEX = "(strpos('0123456789ABCDEF', {c}) - 1)"
_GRAMS = """
WITH b AS (SELECT item_id, list_transform(range(0, length(h) // 2), lambda i: (strpos('0123456789ABCDEF', substr(h, 2 * i + 1, 1)) - 1) * 16 + strpos('0123456789ABCDEF', substr(h, 2 * i + 2, 1)) - 1) AS bs
  FROM (SELECT item_id, '0A' || hex(encode(text)) || '0A' AS h FROM benchmark WHERE text <> '')),
w AS (SELECT item_id, bs, list_transform(range(1, len(bs)), lambda i: ((bs[i] * 31 + bs[i + 1] * 17 + 7)::UBIGINT * 2654435761) % 4294967296) AS ws FROM b),
p AS (SELECT item_id, bs, ws, s, n FROM (SELECT *, unnest(range(1, len(bs) - 1)) AS s FROM w), range(3, 17) AS r(n) WHERE s + n - 1 <= len(bs)),
g AS (SELECT item_id, s, n, bs[s : s + n - 1] AS gs, len(bs) AS size FROM p WHERE n = 3 OR least(ws[s], ws[s + n - 2]) > list_max(ws[s + 1 : s + n - 3])),
h AS (SELECT item_id, s, n, size, list_reduce(list_prepend(1::UHUGEINT, gs::UHUGEINT[]), lambda x, y: (x * 11400714819323198485 + y) % 18446744073709551616)::UBIGINT AS z FROM g),
m1 AS (SELECT item_id, s, n, size, (xor(z, z >> 30)::UHUGEINT * 13787848793156543929 % 18446744073709551616)::UBIGINT AS z FROM h),
m2 AS (SELECT item_id, s, n, size, (xor(z, z >> 27)::UHUGEINT * 10723151780598845931 % 18446744073709551616)::UBIGINT AS z FROM m1),
k AS (SELECT item_id, greatest(s - 2, 0)::INT AS start, least(s - 2 + n, size - 2)::INT AS "end", xor(z, z >> 31) AS z FROM m2)
SELECT item_id, start, "end", CASE WHEN z >= 9223372036854775808 THEN (z::HUGEINT - 18446744073709551616)::BIGINT ELSE z::BIGINT END AS gram FROM k"""
register("sparse_grams", lambda s, d: scan.grams(table(s, d, "benchmark"), _SQL_TABLE, "item_id").where("not folded").select("item_id", "start", "end", "gram"), _GRAMS)
register("gram_df", lambda s, d: scan.grams(table(s, d, "benchmark"), _SQL_TABLE, "item_id").where("not folded").groupBy("gram").agg(F.countDistinct("item_id").alias("df")), f"SELECT gram, count(DISTINCT item_id) AS df FROM ({_GRAMS}) GROUP BY gram")
register("gram_intersection", lambda s, d: scan.grams(table(s, d, "benchmark"), _SQL_TABLE, "item_id").where("not folded").groupBy("gram").agg(F.array_sort(F.collect_set("item_id")).alias("ids")).where(F.size("ids") > 1).groupBy("ids").agg(F.count("*").alias("grams")).select(F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"), "grams"),
    f"SELECT ids, count(*) AS grams FROM (SELECT gram, string_agg(item_id::VARCHAR, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT gram, item_id FROM ({_GRAMS})) GROUP BY gram HAVING count(*) > 1) GROUP BY ids")

_INDEXES: dict[tuple[str, str], str] = {}


def the_index(spark: SparkSession, d: str) -> index.Index:
    """Of documents, built once a session, by weights counted from them."""
    at = (spark.sparkContext.applicationId, d)
    if at not in _INDEXES:
        docs = table(spark, d, "documents")
        weights = WeightTable.from_frame(bigrams.mint(bigrams.pair_counts(docs, "text")))
        root = store.fresh_path(spark, "index")
        index.build(docs, root, weights)
        _INDEXES[at] = root
    return index.open_index(spark, _INDEXES[at])


def indexed(name: str, options: SearchOptions, sql: str) -> None:
    register(f"indexed_{name}", lambda spark, d: index.indexed_search(table(spark, d, "documents"), the_index(spark, d), options, force=True), sql)


F_ = "files_with_matches"
indexed("literal", S("license", mode=F_), _files("license"))
indexed("class", S("l[aeiou]cense", mode=F_), _files("l[aeiou]cense"))
indexed("alternation", S("(thble|nicht|license)s?", mode=F_), _files("(thble|nicht|license)s?"))
indexed("gap", S("license.*nicht|ein.*nicht", mode=F_), _files("license.*nicht|ein.*nicht"))
indexed("repetition", S(VERSION, mode=F_), _files(VERSION))
indexed("ignore_case", S("(?i)LICENSE", mode=F_), _files("license", ", 'i'"))
indexed("anchor", S("^The [a-z]+", mode=F_), _files("^The [a-z]+"))
indexed("word", S("nicht", word=True, mode=F_), _files(r"(^|[^\pL\pM\pN_])nicht([^\pL\pM\pN_]|$)"))
indexed("unicode", S("für [a-z]+en", mode=F_), _files("für [a-z]+en"))
indexed("zero_match", S("zzqxpassword", mode=F_), _files("zzqxpassword"))
indexed("count", S(PHONE, mode="count"), f"SELECT doc_id, count(*) AS n FROM {LINES} WHERE regexp_matches(line, '{PHONE}') GROUP BY doc_id")
indexed("without_match", S("thble", mode="files_without_match"), f"SELECT doc_id FROM documents EXCEPT ({_files('thble')})")
indexed("lines", S("licen[cs]e", mode="lines"), f"SELECT doc_id, line_no, line FROM {LINES} WHERE regexp_matches(line, 'licen[cs]e')")
indexed("multiline", S(r"[a-z]{4}\nThe", multiline=True, mode=F_), r"SELECT doc_id FROM documents WHERE regexp_matches(text, '[a-z]{4}\nThe')")


def _lost(spark, d):
    """Documents that match and are no candidates: none, for any of the patterns."""
    ix, docs, out = the_index(spark, d), table(spark, d, "documents"), None
    for p in ("license", "thble", "nicht", PHONE, VERSION, "(?i)LICENSE", "^The ", r"\bthe\b", "[a-z]+@[a-z]+", "für"):
        o = S(p, mode=F_)
        dec = index.decide(ix, o, force=True)
        if dec.reason:
            continue
        lost = search(docs, o).join(index.candidate_keys(ix, dec.plan, o), "doc_id", "left_anti").select(F.lit(p).alias("pattern"), "doc_id")
        out = lost if out is None else out.union(lost)
    return out


register("index_lost_documents", _lost, "SELECT '' AS pattern, doc_id FROM documents WHERE false")
register("index_postings_by_mask", lambda s, d: segments.by_mask(the_index(s, d).segments))


def _dirty(spark, d):
    """The index is of old texts of the German documents; their keys are known to have changed."""
    docs = table(spark, d, "documents")
    now = docs.withColumn("text", F.when(F.col("lang") == "de", F.concat("text", F.lit(" zzqxpassword"))).otherwise(F.col("text")))
    changed = docs.where("lang = 'de'").select("doc_id")
    return index.indexed_search(now, the_index(spark, d), S("zzqxpassword", mode=F_), force=True, changed=changed)


register("dirty_fold", _dirty, "SELECT doc_id FROM documents WHERE lang = 'de'")


def _manifests(spark, d):
    """French documents come, Spanish ones go, German ones change."""
    docs = table(spark, d, "documents")
    path = F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path")
    old = docs.where("lang <> 'fr'").select(path, F.col("text").alias("c"))
    new = docs.where("lang <> 'es'").select(path, F.when(F.col("lang") == "de", F.upper("text")).otherwise(F.col("text")).alias("c"))
    return maintain.differences(maintain.manifest(old, "path", "c"), maintain.manifest(new, "path", "c"))


register("manifest_diff", _manifests, "SELECT * FROM (SELECT source || '/' || doc_id AS path, CASE lang WHEN 'fr' THEN 'added' WHEN 'es' THEN 'removed' WHEN 'de' THEN CASE WHEN upper(text) <> text THEN 'changed' END END AS change FROM documents) WHERE change IS NOT NULL")

# ---------------------------------------------------------------- byte statistics
_PAIRS = """(SELECT (strpos('0123456789ABCDEF', substr(p, 1, 1)) - 1) * 16 + strpos('0123456789ABCDEF', substr(p, 2, 1)) - 1 AS c1, (strpos('0123456789ABCDEF', substr(p, 3, 1)) - 1) * 16 + strpos('0123456789ABCDEF', substr(p, 4, 1)) - 1 AS c2, n AS cnt
  FROM (SELECT p, count(*) AS n FROM (SELECT substr(h, i, 4) AS p FROM (SELECT h, unnest(range(1, length(h) - 2, 2)) AS i FROM (SELECT hex(encode(text)) AS h FROM {t}))) GROUP BY p))"""
_DOC_PAIRS, _BENCH_PAIRS = _PAIRS.replace("{t}", "documents"), _PAIRS.replace("{t}", "benchmark")
_GRID = "(SELECT (i // 256)::INT AS c1, (i % 256)::INT AS c2 FROM range(65536) AS r(i))"
_MINT = f"(SELECT g.c1, g.c2, CASE WHEN cnt IS NULL THEN 4294967295 ELSE least((SELECT sum(cnt) FROM {_DOC_PAIRS}) // cnt, 4294967295) END::BIGINT AS weight FROM {_GRID} g LEFT JOIN {_DOC_PAIRS} p USING (c1, c2))"
_counts = lambda s, d, name="documents": bigrams.pair_counts(table(s, d, name), "text")
register("bigram_counts", lambda s, d: _counts(s, d), f"SELECT c1::INT AS c1, c2::INT AS c2, cnt FROM {_DOC_PAIRS}")
register("bigram_totals", lambda s, d: bigrams.totals(table(s, d, "documents"), "text"), "SELECT sum(greatest(strlen(text) - 1, 0))::BIGINT AS pairs, sum(strlen(text))::BIGINT AS bytes, count(text) AS values FROM documents")
register("bigram_topk", lambda s, d: bigrams.top_pairs(_counts(s, d), 20), f"SELECT c1::INT AS c1, c2::INT AS c2, cnt FROM {_DOC_PAIRS} ORDER BY cnt DESC, c1, c2 LIMIT 20")
register("bigram_point", lambda s, d: _counts(s, d).where("c1 = 116 and c2 = 104").select("cnt"), f"SELECT cnt FROM {_DOC_PAIRS} WHERE c1 = 116 AND c2 = 104")
register("mint_weights", lambda s, d: bigrams.mint(_counts(s, d)), f"SELECT * FROM {_MINT}")
register("boundary_weights", lambda s, d: bigrams.boundary_discount(bigrams.mint(_counts(s, d))), f"SELECT c1, c2, CASE WHEN c1 IN (95, 46, 47, 45, 58, 10, 13) OR c2 IN (95, 46, 47, 45, 58, 10, 13) OR (c1 BETWEEN 97 AND 122 AND c2 BETWEEN 65 AND 90) THEN greatest(weight // 16, 1) ELSE weight END AS weight FROM {_MINT}")
register("table_inspect", lambda s, d: bigrams.inspect(bigrams.mint(_counts(s, d)), 5), f"SELECT * FROM (SELECT 'lowest' AS side, row_number() OVER (ORDER BY weight, c1, c2)::INT AS rank, c1, c2, weight FROM {_MINT} UNION ALL SELECT 'highest', row_number() OVER (ORDER BY weight DESC, c1, c2)::INT, c1, c2, weight FROM {_MINT}) WHERE rank <= 5")
_KL_BASE = f"""WITH m AS ({_MINT[1:-1]}), f AS (SELECT c1, c2, CASE WHEN weight >= 4294967295 THEN 1e-15 ELSE 1.0::DOUBLE / weight + 1e-15 END AS f FROM m), q AS (SELECT c1, c2, f / (SELECT sum(f) FROM f) AS q FROM f),
  n AS (SELECT g.c1, g.c2, coalesce(cnt, 0) + 1 AS n FROM {_GRID} g LEFT JOIN {_BENCH_PAIRS} USING (c1, c2)), p AS (SELECT c1, c2, n::DOUBLE / (SELECT sum(n) FROM n) AS p FROM n), b AS (SELECT * FROM p JOIN q USING (c1, c2))"""
register("kl_benchmark", lambda s, d: bigrams.divergence(_counts(s, d, "benchmark"), bigrams.mint(_counts(s, d))).select(F.round("kl", 4).alias("kl")), f"{_KL_BASE} SELECT round(greatest(sum(p * ln(p / q)), 0), 4) AS kl FROM b")
register("kl_contributors", lambda s, d: bigrams.contributors(_counts(s, d, "benchmark"), bigrams.mint(_counts(s, d)), 5).select("side", "c1", "c2", F.round("contribution", 6).alias("contribution")),
    f"{_KL_BASE} SELECT side, c1, c2, round(x, 6) AS contribution FROM (SELECT 'under' AS side, c1, c2, p * ln(p / q) AS x, row_number() OVER (ORDER BY p * ln(p / q) DESC, c1, c2) AS r FROM b WHERE p > q UNION ALL SELECT 'over', c1, c2, q * ln(q / p), row_number() OVER (ORDER BY q * ln(q / p) DESC, c1, c2) FROM b WHERE q > p) WHERE r <= 5")

# ---------------------------------------------------------------- quotas
_sized = lambda s, d: table(s, d, "documents").select("doc_id", F.col("lang").alias("family"), "source", F.octet_length("text").cast("long").alias("size"), F.col("doc_id").alias("seq"))
_SIZED = "(SELECT doc_id, lang AS family, source, strlen(text)::BIGINT AS size, doc_id AS seq FROM documents)"
register("lang_bytes", lambda s, d: _sized(s, d).groupBy(F.coalesce("family", F.lit("unknown")).alias("family")).agg(F.sum("size").cast("long").alias("bytes")), f"SELECT coalesce(family, 'unknown') AS family, sum(size)::BIGINT AS bytes FROM {_SIZED} GROUP BY 1")
register("source_mix", lambda s, d: quotas.shares(_sized(s, d), "source", "size"), f"SELECT source, sum(size)::BIGINT AS bytes, round(sum(size)::DOUBLE / (SELECT sum(size) FROM {_SIZED}), 6) AS share FROM {_SIZED} GROUP BY source ORDER BY bytes DESC, source LIMIT 8")
register("quota_head", lambda s, d: quotas.byte_prefix(_sized(s, d), 20_000, "size", ["seq"], ["source"]).select("doc_id"), f"SELECT doc_id FROM (SELECT doc_id, sum(size) OVER (PARTITION BY source ORDER BY seq) AS b FROM {_SIZED}) WHERE b <= 20000")
register("first_n_per_source", lambda s, d: quotas.first_of_each(_sized(s, d), 3, "source", ["seq"]).select("doc_id"), f"SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY seq) AS r FROM {_SIZED}) WHERE r <= 3")
register("rollup_family_source", lambda s, d: quotas.tallies(_sized(s, d)), f"SELECT family, source, sum(size)::BIGINT AS bytes, count(*) AS shards FROM {_SIZED} GROUP BY ROLLUP (family, source)")
register("quota_remaining", lambda s, d: quotas.remaining(_sized(s, d), _sized(s, d).select("family").distinct().withColumn("family_cap", F.lit(300_000).cast("long")), _sized(s, d).select("source").distinct().withColumn("source_cap", F.lit(50_000).cast("long"))).select("doc_id", "remaining"),
    f"SELECT doc_id, greatest(least(300000 - coalesce(sum(size) OVER (PARTITION BY family ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 50000 - coalesce(sum(size) OVER (PARTITION BY source ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)), 0)::BIGINT AS remaining FROM {_SIZED} WHERE family IS NOT NULL AND source IS NOT NULL")
register("round_robin", lambda s, d: quotas.round_robin(_sized(s, d)).select("doc_id", "turn"), f"SELECT doc_id, row_number() OVER (PARTITION BY family ORDER BY n, source)::INT AS turn FROM (SELECT *, row_number() OVER (PARTITION BY family, source ORDER BY seq) AS n FROM {_SIZED})")
register("event_rate", lambda s, d: maintain.windowed_rate(table(s, d, "events").select("event_id", "ts", F.lit(1).cast("long").alias("one")), "ts", "one", 3600).select("event_id", F.round(F.col("rate") * 3600).cast("long").alias("in_window")),
    "SELECT event_id, count(*) OVER (ORDER BY epoch(ts) RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW) AS in_window FROM events")


def _stream_refresh(spark, d):
    """Documents come as a stream of changes into the ledger; the index that is then built answers for all of them."""
    root = store.fresh_path(spark, "stream")
    docs = table(spark, d, "documents")
    docs.where("lang = 'en'").write.parquet(f"{root}/in/a")
    docs.where("lang is null or lang <> 'en'").write.parquet(f"{root}/in/b")
    ledger = maintain.Ledger(spark, f"{root}/dirty", "doc_id")
    changes = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 8).parquet(f"{root}/in/*")
    maintain.watch(changes, ledger, f"{root}/checkpoint").awaitTermination()
    return ledger.rows().groupBy("doc_id").agg(F.count("*").alias("n"))


register("stream_ledger", _stream_refresh, "SELECT doc_id, count(DISTINCT doc_id) AS n FROM documents GROUP BY doc_id")


def _stream_counts(spark, d):
    root = store.fresh_path(spark, "stream")
    docs = table(spark, d, "documents")
    texts = docs.select("text")
    parts = texts.rdd.getNumPartitions()
    # a quarter of the files a batch; where there are as many parts, texts are written as they are read and not shuffled
    (texts if parts >= 4 else texts.repartition(4)).write.parquet(f"{root}/in")
    state = maintain.CountState(spark, f"{root}/state", "documents")
    maintain.count_stream(spark.readStream.schema("text string").option("maxFilesPerTrigger", -(-max(parts, 4) // 4)).parquet(f"{root}/in"), state, "text", f"{root}/checkpoint").awaitTermination()
    return state.counts()


register("stream_bigram_counts", _stream_counts, f"SELECT c1::INT AS c1, c2::INT AS c2, cnt FROM {_DOC_PAIRS}")
