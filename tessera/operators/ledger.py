"""Document ledger: identity, classification, versions, listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tessera.functions.text import fold
from tessera.operators.matching import containing, expanded, packed, with_once
from tessera.session import settle

EXTENSIONS = (".docx", ".pdf", ".md", ".xlsx")

# Document kinds by what their name or text mentions, in order; spreadsheets have rules of their own.
_RECORD_SHORT = r"(?<![\p{L}\p{N}])bbk[đd](?![\p{L}\p{N}])"
_PROCEDURE = "qtkđ|qtkd|quy trình kiểm định|đlvn"
_PROCEDURE_CODE = "qtk[đd]"
_RECORD = "biên bản kiểm định|giấy chứng nhận kiểm định|hồ sơ kiểm định"
_SHEET = "phiếu đo|phieu do|measurement"
_LIST = r"danh mục|danh_muc|catalog"
_CATALOG = r"bi[ểe]u\s*\d|danh mục|danh_muc|danh sách\s*k[đd]v|danh sách kiểm định viên|chuẩn mẫu|chuan mau|catalog"


def reject_reason(name: Column, size: Column, most: int) -> Column:
    """Why an upload is refused: extension, empty, too large; null if it is not."""
    ext = F.lower(F.regexp_extract(name, r"(\.[^.]*)$", 1))
    return F.when(~ext.isin(*EXTENSIONS), "extension").when(size == 0, "empty").when(size > most, "too large")


def safe_stem(name: Column) -> Column:
    """Letters and digits of any script and ``-._`` stay, all else becomes an underscore."""
    return F.regexp_replace(name, r"[^\p{L}\p{N}._-]", "_")


def numbered_stems(rows: DataFrame, order: str) -> DataFrame:
    """``stem`` made unique: the second of a name gets ``_2`` and so on, in ``order``."""
    n = F.row_number().over(Window.partitionBy("stem").orderBy(order))
    return rows.withColumn("stem", F.when(n > 1, F.concat_ws("_", "stem", n.cast("string"))).otherwise(F.col("stem")))


def new_uploads(batch: DataFrame, ledger: DataFrame) -> DataFrame:
    """Uploads (sha256, uploaded_at) whose bytes are new: the first of equal ones, unless the ledger has them with a status other than error."""
    first = batch.groupBy("sha256").agg(F.min_by(F.struct(*[c for c in batch.columns if c != "sha256"]), F.struct("uploaded_at", "file_id")).alias("x")).select("sha256", "x.*")
    return first.join(ledger.filter("ingest_status <> 'error'"), "sha256", "left_anti")


def classify(name: Column, text: Column) -> Column:
    """(doc_type, confidence, branch) by ordered rules."""
    base = F.replace(F.lower(name), F.lit("_"), F.lit(" "))
    hay = F.concat(base, F.lit("\n"), F.lower(F.coalesce(text, F.lit(""))))
    sheet = F.lower(name).rlike(r"\.xlsx?$")
    out = lambda kind, sure, branch: F.struct(F.lit(kind).alias("doc_type"), F.lit(sure).alias("confidence"), F.lit(branch).alias("branch"))
    record_like = hay.rlike(_RECORD_SHORT) | hay.rlike(_RECORD) | hay.rlike(_PROCEDURE_CODE)
    return (
        F.when(sheet & hay.rlike(_SHEET), out("phieu_do", 0.90, "sheet form"))
        .when(sheet & record_like, out("ho_so_kiem_dinh", 0.90, "sheet record"))
        .when(sheet & hay.rlike(_CATALOG), out("danh_muc", 0.85, "sheet list"))
        .when(sheet, out("khac", 0.20, "sheet other"))
        .when(hay.rlike(_RECORD_SHORT), out("ho_so_kiem_dinh", 0.93, "record short"))
        .when(hay.rlike(_CATALOG) & ~hay.rlike(_PROCEDURE_CODE), out("danh_muc", 0.85, "catalog"))
        .when(hay.rlike(_PROCEDURE), out("qtkd", 0.98, "procedure"))
        .when(hay.rlike(_RECORD), out("ho_so_kiem_dinh", 0.95, "record"))
        .when(hay.rlike(_SHEET), out("phieu_do", 0.90, "form"))
        .when(hay.rlike(_LIST), out("danh_muc", 0.85, "list"))
        .otherwise(out("khac", 0.20, "other"))
    )


# A procedure's code with its year, and the lines that end its title.
_CODE = r"(?i)QTK[ĐDđ]\s*([0-9]+(?:\.[0-9]+)?)\s*[:\-]?\s*(\d{4})"
_STOP = r"(?iU)^(QUY TRÌNH KIỂM ĐỊNH|HÀ NỘI|HỒ CHÍ MINH)\b"


def procedure_header(text: Column) -> Column:
    """(number, year, title): the first line with a code, and the non-blank lines after it up to a closing line; null without a code."""
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.trim(x))
    at = F.array_position(F.transform(lines, lambda x: x.rlike(_CODE)), True)
    line = F.element_at(lines, F.greatest(at, F.lit(1)).cast("int"))
    rest = F.filter(F.slice(lines, at.cast("int") + 1, F.size(lines)), lambda x: x != "")
    stop = F.array_position(F.transform(rest, lambda x: x.rlike(_STOP)), True)
    kept = F.when(stop > 0, F.slice(rest, F.lit(1), F.greatest(stop - 1, F.lit(0)).cast("int"))).otherwise(rest)
    return F.when(at > 0, F.struct(F.regexp_extract(line, _CODE, 1).alias("number"), F.regexp_extract(line, _CODE, 2).cast("int").alias("year"), F.array_join(kept, " ").alias("title")))


def edition(stem: Column) -> Column:
    """What follows the year in a procedure's stem."""
    return F.nullif(F.regexp_replace(F.regexp_extract(stem, r"(?i)QTKD[_\s]*[0-9.]+[_\s]+\d{4}[_\s]+(.+)$", 1), r"^[ _]+|[ _]+$", ""), F.lit(""))


def current_versions(docs: DataFrame) -> DataFrame:
    """(number, document_id) that holds each number after all have been processed in order: a newer year wins, an equal or missing year lets the later one win.

    With a missing year the outcome depends on the order, so each number's documents are folded in it, three numbers for each: a history of a million versions of one
    number is some 30 MB in one row, and numbers have a few versions each.
    """
    listed = F.array_sort(F.collect_list(F.struct("processed_at", "document_id", "year")))
    older = lambda cur, new: cur["year"].isNotNull() & new["year"].isNotNull() & (cur["year"] > new["year"])
    return docs.groupBy("number").agg(listed.alias("x")).select("number", F.reduce(F.slice("x", 2, F.size("x")), F.get("x", F.lit(0)), lambda cur, new: F.when(older(cur, new), cur).otherwise(new))["document_id"].alias("document_id"))


def supersede(docs: DataFrame) -> DataFrame:
    """``status`` of every document: current, or superseded by its number's holder."""
    return docs.join(current_versions(docs).withColumnRenamed("document_id", "holder"), "number").select("document_id", "number", F.when(F.col("document_id") == F.col("holder"), "current").otherwise("superseded").alias("status"))


def successors(docs: DataFrame, deleted: DataFrame) -> DataFrame:
    """(number, document_id) that take over where the current version is deleted: the newest year, then the latest upload."""
    held = current_versions(docs).join(deleted, "document_id", "left_semi").select("number")
    left = docs.join(deleted, "document_id", "left_anti").join(held, "number", "left_semi")
    return left.groupBy("number").agg(F.max_by("document_id", F.struct(F.coalesce("year", F.lit(-1)), "processed_at", "document_id")).alias("document_id"))


def infer_device(titles: DataFrame, devices: DataFrame, by_number: DataFrame | None = None) -> DataFrame:
    """The device type whose alias is the longest contained in the title (ties: the first listed). Rows (id, title), (ord, device, alias).

    With ``by_number`` (number, device; the first by name where a number has several), a title without an alias takes the device of its ``number``.
    """
    norm = lambda c: F.lower(F.trim(c))
    a = devices.select("ord", "device", norm(F.col("alias")).alias("alias")).filter("alias <> ''").groupBy("alias").agg(F.min("ord").alias("ord"), F.min_by("device", "ord").alias("device"))
    hit = containing(titles.select("id", norm(F.col("title")).alias("t")), a, "t", "alias")
    best = hit.groupBy("id").agg(F.max_by("device", F.struct(F.length("alias"), -F.col("ord"))).alias("device"))
    if by_number is None:
        return titles.select("id").join(best, "id", "left")
    numbered = by_number.groupBy("number").agg(F.min("device").alias("by_number"))
    return titles.select("id", "number").join(best, "id", "left").join(numbered, "number", "left").select("id", F.coalesce("device", "by_number").alias("device"))


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """New rows in the place of old ones with their key."""
    return old.join(new.select(*key).distinct(), key, "left_anti").unionByName(new)


def plan(existing: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """``action``: create or update."""
    have = existing.select(F.col(key).alias("have")).distinct()
    return wanted.join(have, F.col(key) == F.col("have"), "left").withColumn("action", F.when(F.col("have").isNull(), "create").otherwise("update")).drop("have")


def alias_numbers(devices: DataFrame) -> DataFrame:
    """alias -> sorted distinct numbers, over names and aliases in lower case."""
    a = devices.select("number", F.explode(F.array_union(F.array("name"), F.col("aliases"))).alias("alias"))
    return a.select(F.lower(F.trim("alias")).alias("alias"), "number").filter("alias <> ''").groupBy("alias").agg(F.array_sort(F.collect_set("number")).alias("numbers"))


def human_size(n: Column) -> Column:
    """Bytes as text with one decimal for KB and more."""
    return F.when(n < 1024, F.format_string("%d B", n)).when(n < 1024 * 1024, F.format_string("%.1f KB", F.bround(n / 1024.0, 1))).otherwise(F.format_string("%.1f MB", F.bround(n / (1024.0 * 1024), 1)))


def listing(ledger: DataFrame, jobs: DataFrame) -> DataFrame:
    """Newest first: size text, day, and the status of the running job before that of the ledger."""
    rows = ledger.join(jobs.select("document_id", "stage"), "document_id", "left")
    status = F.when(F.col("stage").isNotNull() & (F.col("stage") != "done"), F.col("stage")).when(F.col("ingest_status") == "error", "error").otherwise("ready")
    return rows.orderBy(F.desc("uploaded_at"), "document_id").select("document_id", human_size(F.col("size_bytes")).alias("size"), F.date_format("uploaded_at", "dd/MM/yyyy").alias("day"), status.alias("status"))


def serial_date(n: Column) -> Column:
    """A spreadsheet's day number as a date."""
    return F.date_add(F.lit("1899-12-30").cast("date"), n.cast("int"))


def short_number(x: Column) -> Column:
    """A number's shortest text, with a decimal comma."""
    return F.replace(F.regexp_replace(x.cast("string"), r"\.0$", ""), F.lit("."), F.lit(","))


def toc(lines: DataFrame, head: str, most: int = 120, orphans: int = 2) -> DataFrame:
    """Table of contents: (doc, number, title, page) from the first ``most`` lines after the head line, up to the line with which more than ``orphans`` other lines follow in a row.

    Rows: doc, pos, text. The first entry of a number counts.
    """
    start = lines.filter(F.lower(F.trim("text")) == head.lower()).groupBy("doc").agg(F.min("pos").alias("start"))
    rows = lines.join(start, "doc").filter((F.col("pos") > F.col("start")) & (F.col("pos") <= F.col("start") + most) & (F.trim("text") != ""))
    entry = r"^(\d+(?:\.\d+)*)\.?\s+(.+?)[\s.…]+(\d+)$"
    hit = F.col("text").rlike(entry)
    w = Window.partitionBy("doc").orderBy("pos")
    rows = rows.withColumn("hits", F.sum(hit.cast("int")).over(w)).withColumn("miss", F.sum((~hit).cast("int")).over(Window.partitionBy("doc", "hits").orderBy("pos")))
    ended = F.max(((F.col("miss") > orphans)).cast("int")).over(w)
    good = rows.withColumn("ended", ended).filter((F.col("ended") == 0) & hit)
    cut = good.select("doc", "pos", F.regexp_extract("text", entry, 1).alias("number"), F.regexp_extract("text", entry, 2).alias("title"), F.regexp_extract("text", entry, 3).cast("int").alias("page"))
    return cut.groupBy("doc", "number").agg(F.min_by(F.struct("title", "page"), "pos").alias("x")).select("doc", "number", "x.title", "x.page")


#: Fixed value: letters of a title that must stand in the other one.
TITLE_START = 12


def page_of(sections: DataFrame, contents: DataFrame) -> DataFrame:
    """(doc, number, page, exact): the section's own page, or that of its nearest numbered ancestor. Rows: doc, number, and ``title`` where it is known.

    With titles, a section whose own number stands in the contents under another title has no page (and is not exact): neither title holds the start of the other one. Empty titles clash with nothing.
    """
    titled = "title" in sections.columns
    keys = ["doc", "number", *(["title"] if titled else [])]
    parts = F.split("number", r"\.")
    ups = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "."))
    wanted = sections.select(*keys).distinct()
    rows = wanted.select(*keys, F.explode(ups).alias("up")).join(contents.select("doc", F.col("number").alias("up"), "page", fold(F.col("title")).alias("there")), ["doc", "up"])
    best = rows.withColumn("given", fold(F.coalesce("title", F.lit(""))) if titled else F.lit("")).groupBy(*keys).agg(F.max_by(F.struct("page", "up", "given", "there"), F.length("up")).alias("x"))
    exact = F.col("x.up") == F.col("number")
    held = lambda a, b: F.contains(a, F.substring(b, 1, TITLE_START))
    clash = exact & (F.col("x.given") != "") & (F.col("x.there") != "") & ~held(F.col("x.given"), F.col("x.there")) & ~held(F.col("x.there"), F.col("x.given"))
    found = best.select(*(F.col(c).alias(f"own_{c}") for c in keys), F.when(~clash, F.col("x.page")).alias("page"), (exact & ~clash).alias("exact"))
    on = F.lit(True)
    for c in keys:
        on = on & F.col(c).eqNullSafe(F.col(f"own_{c}"))
    return wanted.join(found, on, "left").select(*keys, "page", "exact")


def replacements(docs: DataFrame, most: int = 12_000) -> DataFrame:
    """(doc, new, old): in the first ``most`` characters, paragraphs that speak of replacing and name two codes or more."""
    paragraphs = docs.select("doc", F.explode(F.split(F.substring("text", 1, most), r"\n\s*\n")).alias("p"))
    codes = F.array_distinct(F.regexp_extract_all("p", F.lit(r"(?<!\d)(\d\.\d{3})(?!\d)"), 1))
    rows = paragraphs.filter(F.lower("p").rlike("thay thế|thay the")).select("doc", codes.alias("c")).filter("size(c) >= 2")
    return rows.select("doc", F.get("c", F.lit(0)).alias("new"), F.explode(F.slice("c", F.lit(2), F.size("c"))).alias("old")).distinct()


_CODES = r"(?<!\d)(\d\.\d{3})(?!\d)"
_APPENDIX = r"\bphu luc\s+([a-z])\b"


def asks_appendix(query: Column) -> Column:
    """The letter of the one appendix whose topic a query asks for, or null: it names a code and one appendix, and asks what it is about, not for values in it."""
    return _asks_folded(fold(query))


def _asks_folded(q: Column) -> Column:
    letters = F.array_distinct(F.regexp_extract_all(q, F.lit(_APPENDIX), 1))
    topic = q.rlike("noi dung gi|noi dung chinh|la gi|ve gi") & ~q.rlike("cong thuc|he so|dieu kien|tinh toan") & ~q.rlike(r"phu luc\s+[a-z]\s*(?:va|,|/)\s*[a-z]\b")
    return F.when(q.rlike(_CODES) & (F.size(letters) == 1) & topic, F.get(letters, F.lit(0)))


def _topic_at(lines: Column, letter: Column) -> Column:
    """Number of the first heading line of an appendix, from 1; 0 where there is none."""
    heads = F.transform(lines, lambda x: x.startswith("#") & (F.regexp_replace(fold(x), r"^#+\s*", "") == F.concat(F.lit("phu luc "), letter)))
    return F.array_position(heads, True).cast("int")


def _topic_lines(lines: Column, at: Column) -> Column:
    """(begun, over, lines): the lines of an appendix's title, whose heading is line ``at``; marks of its kind in parentheses come along, blank lines before it don't count."""

    def step(state: Column, line: Column) -> Column:
        x = F.trim(line)
        kind = fold(F.regexp_replace(x, "^[# ]+", "")).isin("(quy dinh)", "(tham khao)")
        over = (x.startswith("#") & fold(x).rlike(_APPENDIX)) | (~kind & (x.contains("|") | x.contains("$") | x.rlike(r"^[A-Z]\.\d")))
        more = F.struct((state["begun"] | ~kind).alias("begun"), F.lit(False).alias("over"), F.concat(state["lines"], F.array(x)).alias("lines"))
        stop = F.struct(state["begun"].alias("begun"), F.lit(True).alias("over"), state["lines"].alias("lines"))
        return F.when(state["over"], state).when(x == "", F.when(state["begun"], stop).otherwise(state)).when(over, stop).otherwise(more)

    start = F.struct(F.lit(False).alias("begun"), F.lit(False).alias("over"), F.array().cast("array<string>").alias("lines"))
    return F.aggregate(F.slice(lines, at + 1, F.size(lines)), start, step)


def appendix_topics(queries: DataFrame, docs: DataFrame) -> DataFrame:
    """(query_id, file_stem, section, text): what an appendix that a query asks for is about, in every document whose stem has a code that the query names.

    Only for queries all of whose codes stand in the stems or texts that were found. Rows (query_id, query), (file_stem, text); file_stem is a key. A document is looked through once for each letter that is asked of it,
    and queries that ask for the same are answered once; pairs are made last.
    """
    codes_of = lambda text: F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(_CODES), 1)))
    # small files are read by few tasks, and a text takes far longer to look through than to read
    spread = lambda rows: rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    q = with_once(spread(queries.select("query_id", "query")), "folded", fold(F.col("query")))
    q = with_once(q, "letter", _asks_folded(F.col("folded"))).filter("letter IS NOT NULL").withColumn("codes", codes_of(F.col("folded"))).select("query_id", F.struct("letter", "codes").alias("asked"))
    kinds = settle(q.select("asked").distinct().select("asked", "asked.letter", F.explode("asked.codes").alias("code")))
    named = docs.select("file_stem", F.explode(codes_of(F.col("file_stem"))).alias("code")).join(kinds.select("code", "letter").distinct(), "code")
    wanted = named.select("file_stem", "letter").distinct().join(docs, "file_stem")
    lines = with_once(spread(wanted), "lines", F.split("text", r"\r?\n"))
    hits = with_once(with_once(lines, "at", _topic_at(F.col("lines"), F.col("letter"))).filter("at > 0"), "x", _topic_lines(F.col("lines"), F.col("at"))).filter("x.begun")
    rows = hits.select("file_stem", "letter", F.trim(F.regexp_replace(F.element_at("lines", F.col("at")), "^[# ]+", "")).alias("section"), F.concat_ws("\n\n", F.element_at("lines", F.col("at")), "x.lines").alias("text"))
    rows = settle(rows.withColumn("codes", codes_of(F.concat_ws(" ", "file_stem", "text"))))
    of_code = rows.join(named.select("file_stem", "letter", "code").distinct(), ["file_stem", "letter"])
    # one row a code and letter with the codes of what was found by it
    seen = of_code.select("code", "letter", F.explode("codes").alias("c")).distinct()
    covered = kinds.join(seen, ["code", "letter"]).select("asked", F.col("c").alias("code")).distinct()
    answered = settle(kinds.select("asked").distinct().join(kinds.select("asked", "code").join(covered, ["asked", "code"], "left_anti").select("asked").distinct(), "asked", "left_anti"))
    found = kinds.join(answered, "asked").join(of_code.select("code", "letter", "file_stem", "section", "text"), ["code", "letter"]).select("asked", "file_stem", "section", "text").distinct()
    # queries are brought to each piece of their kind's answers, so pieces are as long as a row may be
    packs = packed(found, "asked", F.struct("file_stem", "section", "text"), 4096)
    return expanded(q, packs, "asked", "x").select("query_id", "x.file_stem", "x.section", "x.text")
