"""Text, date and array function queries."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kiteloom.functions import legacy, texts
from kiteloom.operators import sequences
from kiteloom.operators.ranking import running_within
from kiteloom.plans.registry import Family
from kiteloom.plans.script import in_script
from kiteloom.sources.tables import table

FAMILY = Family("texts")
add, sql = FAMILY.add, FAMILY.sql


def _docs(spark, d):
    return table(spark, d, "documents")


@add("tx1_normalise", "SELECT doc_id, md5(lower(trim(regexp_replace(text, '[\\s\\x{00A0}]+', ' ', 'g')))) AS norm FROM documents")
def tx1(spark, d):
    return _docs(spark, d).select("doc_id", F.md5(texts.normalise(F.col("text"))).alias("norm"))


@add("tx2_nfc", "SELECT doc_id, length(nfc_normalize(text)) AS n FROM documents")
def tx2(spark, d):
    return _docs(spark, d).select("doc_id", F.length(texts.composed(F.col("text"))).cast("long").alias("n"))


@add("tx3_sentences", "SELECT doc_id, CAST(len(list_filter(list_transform(string_split_regex(regexp_replace(text, '([।.!?])\\s+', '\\1' || chr(1), 'g'), chr(1) || '|\\n{2,}'), lambda x: trim(x)), lambda x: x <> '')) AS INTEGER) AS n FROM documents")
def tx3(spark, d):
    return _docs(spark, d).select("doc_id", F.size(texts.sentences(F.col("text"))).alias("n"))


def _any(pattern: str, flags: str = "") -> str:
    return f"regexp_matches(text, '(?{flags or 's'}){pattern}')"


#: The engines' patterns differ in look-ahead: an era mark after a year is counted twice instead.
_JUNK = f"""SELECT doc_id, CASE WHEN {_any(texts.PROMOTION, 'i')} THEN 'promo'
    WHEN {_any(texts.QUESTION_NUMBER)} AND len(regexp_extract_all(text, '{texts.QUESTION_OPTION}')) >= 3 THEN 'mcq_dump'
    WHEN {_any(texts.CONTENTS_WORDS, 'i')} OR len(regexp_extract_all(text, '{texts.PAGE_RANGE}')) >= 4 THEN 'toc'
    WHEN {_any(texts.BAD_YEAR_RANGE)} OR {_any(texts.BAD_YEAR.replace('|ई(?![.०]?' + chr(92) + 's*पू)', ''))}
      OR len(regexp_extract_all(text, '[4-9][0-9]{{3}}\\s*ई')) > len(regexp_extract_all(text, '[4-9][0-9]{{3}}\\s*ई[.०]?\\s*पू')) THEN 'bad_year' END AS junk FROM documents"""


@add("tx4_junk_class", _JUNK)
def tx4(spark, d):
    return _docs(spark, d).select("doc_id", texts.junk_class(F.col("text")).alias("junk"))


@add("tx6_split_oversize")
def tx6(spark, d):
    """Texts over 6,000 characters in parts cut at sentence ends, or hard where one is longer."""
    parts = F.flatten(F.transform(texts.sentences(F.col("text")), lambda s: F.transform(texts_cut(s, 6000), lambda p: p)))
    groups = sequences.pack_fold(F.transform(parts, lambda p: F.length(p).cast("long") + 1), 6000, 6000)
    rows = _docs(spark, d).withColumn("parts", parts)
    zipped = rows.select("doc_id", F.explode(F.arrays_zip(F.transform("parts", lambda p: F.length(p)).alias("n"), groups.alias("g"))).alias("p"))
    return zipped.groupBy("doc_id", F.col("p.g").alias("part")).agg(F.sum("p.n").alias("chars"))


def texts_cut(text, size):
    return F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.length(text) / float(size)) - 1, F.lit(0)).cast("int")), lambda i: F.substr(text, i * size + 1, F.lit(size)))


_PARAGRAPHS = """WITH RECURSIVE t AS (SELECT doc_id, i, length(p) AS size FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS p, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents)),
 f AS (SELECT doc_id, i, 0 AS g, size AS cur FROM t WHERE i = 1 UNION ALL SELECT t.doc_id, t.i, CASE WHEN f.cur > 0 AND f.cur + t.size > 1500 THEN f.g + 1 ELSE f.g END, CASE WHEN f.cur > 0 AND f.cur + t.size > 1500 THEN t.size ELSE f.cur + t.size END FROM f JOIN t ON t.doc_id = f.doc_id AND t.i = f.i + 1)
 SELECT doc_id, CAST(max(g) + 1 AS INTEGER) AS parts FROM f GROUP BY doc_id"""


@add("tx7_paragraph_packing", _PARAGRAPHS)
def tx7(spark, d):
    sizes = F.transform(F.split("text", "\n"), lambda p: F.length(p).cast("long"))
    groups = sequences.pack_fold(sizes, 1500, 1 << 60)
    return _docs(spark, d).select("doc_id", (F.element_at(groups, -1) + 1).alias("parts"))


@add("tx8_balanced_groups", "SELECT doc_id, CAST(floor((cum - 1) * 4 / total) AS BIGINT) AS grp FROM (SELECT doc_id, sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS cum, sum(n_chars) OVER (PARTITION BY source) AS total FROM documents)")
def tx8(spark, d):
    docs = _docs(spark, d).select("doc_id", "source", "n_chars")
    totals = docs.groupBy("source").agg(F.sum("n_chars").alias("total"))
    summed = running_within(docs, "source", ["doc_id"], "n_chars", "cum").join(totals, "source")
    return summed.select("doc_id", F.floor((F.col("cum") - 1) * 4 / F.col("total")).alias("grp"))


@add("tx9_needs_restructure", "SELECT doc_id, (contains(lower(text), 'mcq') AND len(regexp_extract_all(text, '\\([a-d]\\)')) >= 2) OR length(text) - length(translate(text, '=+√∑∫×÷', '')) >= 4 AS needs FROM documents")
def tx9(spark, d):
    return _docs(spark, d).select("doc_id", texts.needs_restructure(F.col("text")).alias("needs"))


_TABLE = "trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?i)</t[dh]>', ' | ', 'g'), '(?i)<br\\s*/?>', ' ', 'g'), '<[^>]+>', chr(10), 'g'), chr(10) || '{3,}', chr(10) || chr(10), 'g'))"


@add("tx10_table_text", f"SELECT page_id, md5({_TABLE}) AS body FROM pages")
def tx10(spark, d):
    return table(spark, d, "pages").select("page_id", F.md5(texts.table_text(F.col("html"))).alias("body"))


@add("tx11_html_text", "SELECT page_id, length(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(html, '(?i)<br\\s*/?>|</tr>|</p>|</h[1-6]>|</li>', chr(10), 'g'), '(?i)</t[dh]>', '  ', 'g'), '<[^>]+>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&nbsp;', chr(160)), '&amp;', '&')) AS n FROM pages")
def tx11(spark, d):
    return table(spark, d, "pages").select("page_id", F.length(texts.html_text(F.col("html"))).cast("long").alias("n"))


_UNESCAPED = "replace(replace(replace(replace(replace(replace({}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&nbsp;', chr(160)), '&amp;', '&')"


def _without(html: str, tags: tuple[str, ...], by: str) -> str:
    """SQL: markup without the elements of some tags and comments."""
    for tag in tags:
        html = f"regexp_replace({html}, '(?is)<{tag}\\b.*?</{tag}>', '{by}', 'g')"
    return f"regexp_replace({html}, '(?s)<!--.*?-->', '{by}', 'g')"


_BARE = _without("html", ("script", "style", "nav", "header", "footer", "aside", "iframe", "noscript"), " ")
_PLAIN = _UNESCAPED.format(f"regexp_replace({_BARE}, '<[^>]+>', ' ', 'g')")


@add("tx12_page_text", f"SELECT page_id, substr(trim(regexp_replace({_PLAIN}, '[\\s\\x{{00A0}}]+', ' ', 'g')), 1, 8000) AS body FROM pages")
def tx12(spark, d):
    return table(spark, d, "pages").select("page_id", texts.page_text(F.col("html")).alias("body"))


@add("tx13_article_text")
def tx13(spark, d):
    return table(spark, d, "pages").select("page_id", texts.article_text(F.col("html")).alias("body"))


@add("tx14_script_ratio", "SELECT doc_id, round(CASE WHEN length(regexp_replace(text, '[^\\p{L}]', '', 'g')) = 0 THEN 0.0 ELSE length(regexp_replace(text, '[^à-öø-ÿß]', '', 'g')) / CAST(length(regexp_replace(text, '[^\\p{L}]', '', 'g')) AS DOUBLE) END, 6) AS ratio FROM documents")
def tx14(spark, d):
    return _docs(spark, d).select("doc_id", F.round(texts.script_ratio(F.col("text"), "[à-öø-ÿß]", "\\p{L}"), 6).alias("ratio"))


@add("tx15_legacy_font_vote")
def tx15(spark, d):
    return _docs(spark, d).select("doc_id", texts.legacy_font(F.col("text")).alias("legacy"))


@add("tx16_garble_density")
def tx16(spark, d):
    """Latin letters stand for signs, since the test texts hold no Devanagari."""
    signs = F.translate("text", "abeoiu", "्ाीुण>")
    return _docs(spark, d).select("doc_id", F.round(texts.garble_density(signs), 6).alias("density"))


#: Formats of the test texts, by marks that these have.
_FORMATS = (("figure", r"\[[0-9]+\]"), ("match", r" \| "), ("assertion", r"[*#]{3}"), ("statement", r"(?m)^\s*[-•*]"), ("order", r"(?m)^\s*[0-9]+[.)]"))


@add("tx18_format", "SELECT doc_id, CASE " + " ".join(f"WHEN regexp_matches(text, '{p}') THEN '{n}'" for n, p in _FORMATS) + " ELSE 'plain' END AS format FROM documents")
def tx18(spark, d):
    return _docs(spark, d).select("doc_id", texts.format_of(F.col("text"), _FORMATS).alias("format"))


_VALUES = "SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN CAST(1900 + p_size AS VARCHAR) WHEN 1 THEN CAST(p_size AS VARCHAR) WHEN 2 THEN p_size || ' km' WHEN 3 THEN 'शब्द' ELSE p_type END AS v FROM part"
_CLASS = "CASE WHEN regexp_full_match(trim(v), '(1[0-9]|20)[0-9]{2}') THEN 'year' WHEN regexp_full_match(trim(v), '[0-9][0-9,]*([.][0-9]+)?') THEN 'number' WHEN regexp_full_match(trim(v), '[0-9][0-9,.]* *[a-zA-Z%]+') THEN 'measure' WHEN regexp_matches(v, '[ऀ-ॿ]') THEN 'script' ELSE 'text' END"


def _valued(spark, d):
    table(spark, d, "part").createOrReplaceTempView("part")
    return spark.sql(_VALUES.replace("VARCHAR", "STRING")).withColumn("kind", texts.value_class(F.col("v")))


@add("tx21_value_class", f"SELECT p_partkey, {_CLASS} AS kind FROM ({_VALUES})")
def tx21(spark, d):
    return _valued(spark, d).select("p_partkey", "kind")


#: Four values a group, of which the last is of another class in most groups.
_FOURS = "SELECT CAST(floor(p_partkey / 4) AS BIGINT) AS grp, p_partkey, CASE WHEN p_partkey % 4 = 3 AND floor(p_partkey / 4) % 3 > 0 THEN 'शब्द' WHEN floor(p_partkey / 4) % 2 = 0 THEN CAST(1900 + p_size AS VARCHAR) ELSE p_type END AS v FROM part"


@add("tx22_odd_one_out", f"WITH v AS (SELECT grp, p_partkey, {_CLASS} AS kind FROM ({_FOURS})), c AS (SELECT grp, kind, count(*) AS n, min(p_partkey) AS odd, sum(count(*)) OVER (PARTITION BY grp) AS total FROM v GROUP BY 1, 2) SELECT grp, min(odd) AS odd FROM c WHERE n = 1 AND total = 4 GROUP BY grp HAVING count(*) = 1")
def tx22(spark, d):
    table(spark, d, "part").createOrReplaceTempView("part")
    rows = spark.sql(_FOURS.replace("VARCHAR", "STRING")).withColumn("kind", texts.value_class(F.col("v")))
    kinds = rows.groupBy("grp", "kind").agg(F.count(F.lit(1)).alias("n"), F.min("p_partkey").alias("odd"))
    each = kinds.groupBy("grp").agg(F.sum("n").alias("total"), F.count_if(F.col("n") == 1).alias("single"), F.min(F.when(F.col("n") == 1, F.col("odd"))).alias("odd"))
    return each.filter("total = 4 AND single = 1").select("grp", "odd")


_URL = "CASE p_partkey % 5 WHEN 0 THEN concat('https://x.example/in/', replace(lower(p_name), ' ', '-'), '-ab12cd34ef/?a=1') WHEN 1 THEN concat('https://x.example/in/', replace(lower(p_name), ' ', '_'), '-0a1') WHEN 2 THEN 'x.example/in/0a1b2c3d' WHEN 3 THEN concat('https://x.example/company/', p_name) ELSE concat('/in/-', replace(lower(p_name), ' ', '--'), '#top') END"


@add("tx23_profile_name", """SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN n WHEN 1 THEN n || ' 0a1' WHEN 2 THEN '0a1b2c3d' WHEN 3 THEN '' ELSE n END AS name FROM (SELECT p_partkey, array_to_string(list_transform(string_split(lower(p_name), ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS n FROM part)""")
def tx23(spark, d):
    return table(spark, d, "part").select("p_partkey", texts.profile_name(F.expr(_URL)).alias("name"))


@add("tx24_mail_first_name", "SELECT c_custkey, upper(substr(w, 1, 1)) || lower(substr(w, 2)) AS name FROM (SELECT c_custkey, lower(c_mktsegment) AS w FROM customer)")
def tx24(spark, d):
    mail = F.concat(F.lower("c_mktsegment"), F.lit("7.of+x@mail.example"))
    return table(spark, d, "customer").select("c_custkey", texts.mail_first_name(mail).alias("name"))


_STAGE = "CASE event_type WHEN 'view' THEN 'commented' WHEN 'click' THEN 'accepted' WHEN 'signup' THEN 'first_msg' WHEN 'purchase' THEN 'engaged' ELSE 'won' END"


@add("tx25_due_date", f"""WITH s AS (SELECT user_id, {_STAGE} AS stage, ts, event_id, value FROM events), l AS (SELECT user_id, arg_max(stage, (ts, event_id)) AS stage, count(*) FILTER (WHERE value > 95) % 2 = 1 AS replied FROM s GROUP BY user_id),
  h AS (SELECT user_id, stage, CAST(max(ts) AS DATE) AS entered FROM s GROUP BY user_id, stage)
  SELECT user_id, l.stage, replied, CASE l.stage WHEN 'commented' THEN entered + 2 WHEN 'accepted' THEN entered WHEN 'first_msg' THEN CASE WHEN NOT replied THEN entered + 3 END WHEN 'engaged' THEN CASE WHEN NOT replied THEN entered + 30 END END AS due FROM l JOIN h USING (user_id, stage)""")
def tx25(spark, d):
    """The next action of every user's last stage, counted from the last day it was entered."""
    steps = table(spark, d, "events").withColumn("stage", F.expr(_STAGE))
    last = steps.groupBy("user_id").agg(F.max_by("stage", F.struct("ts", "event_id")).alias("stage"), (F.count_if(F.col("value") > 95) % 2 == 1).alias("replied"))
    entered = steps.groupBy("user_id", "stage").agg(F.to_date(F.max("ts")).alias("entered"))
    return last.join(entered, ["user_id", "stage"]).select("user_id", "stage", "replied", texts.next_action(F.col("stage"), F.col("entered"), F.col("replied")).alias("due"))


sql("tx26_week_bounds", "SELECT o_orderkey, cast(date_trunc('week', o_orderdate) AS DATE) AS monday, date_add(cast(date_trunc('week', o_orderdate) AS DATE), 6) AS sunday FROM orders",
    "SELECT o_orderkey, CAST(date_trunc('week', o_orderdate) AS DATE) AS monday, CAST(date_trunc('week', o_orderdate) AS DATE) + 6 AS sunday FROM orders")


#: What a week should have of each type: the mean of all weeks and a fifth more.
@add("tx27_weekly_plan", """WITH w AS (SELECT CAST(date_trunc('week', ts) AS DATE) AS week, event_type AS kind, count(*) AS n FROM events GROUP BY 1, 2), t AS (SELECT kind, CAST(ceil(sum(n) * 1.2 / (SELECT count(DISTINCT week) FROM w)) AS BIGINT) AS want FROM w GROUP BY kind),
  g AS (SELECT week, t.kind, least(greatest(want - coalesce(n, 0), 0), 9) AS gap FROM (SELECT DISTINCT week FROM w) CROSS JOIN t LEFT JOIN w USING (week, kind)),
  q AS (SELECT week, kind, row_number() OVER (PARTITION BY week ORDER BY i, kind) AS rn FROM (SELECT week, kind, unnest(range(1, gap + 1)) AS i FROM g)),
  d AS (SELECT week, week + CAST(i AS INTEGER) AS day, row_number() OVER (PARTITION BY week ORDER BY i) AS rn FROM (SELECT DISTINCT week FROM w), range(7) r(i) WHERE i NOT IN (1, 4))
  SELECT q.week, q.kind, q.rn, d.day FROM q LEFT JOIN d USING (week, rn)""")
def tx27(spark, d):
    """Types that a week lacks, at most nine of each, in turn on its free days; what is over has no day."""
    counts = table(spark, d, "events").groupBy(F.to_date(F.date_trunc("week", "ts")).alias("week"), F.col("event_type").alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    weeks = counts.select("week").distinct()
    number = weeks.agg(F.count(F.lit(1)).alias("weeks"))  # one row
    targets = counts.groupBy("kind").agg(F.sum("n").alias("n")).crossJoin(F.broadcast(number)).select("kind", F.ceil(F.col("n") * 1.2 / F.col("weeks")).alias("want"))
    kinds = targets.agg(F.collect_list(F.struct("kind", "want")).alias("kinds"))  # a row of a few event types
    asked = weeks.crossJoin(F.broadcast(kinds)).select("week", F.explode("kinds").alias("k")).select("week", "k.kind", "k.want")
    gap = F.least(F.greatest(F.col("want") - F.coalesce("n", F.lit(0)), F.lit(0)), F.lit(9)).cast("int")
    need = asked.join(counts, ["week", "kind"], "left").withColumn("gap", gap).filter("gap > 0").select("week", "kind", F.explode(F.sequence(F.lit(1), F.col("gap"))).alias("i"))
    queue = need.select("week", "kind", F.row_number().over(Window.partitionBy("week").orderBy("i", "kind")).alias("rn"))
    free = F.array(*[F.date_add("week", i) for i in range(7) if i not in (1, 4)])
    days = weeks.select("week", F.posexplode(free).alias("at", "day")).select("week", (F.col("at") + 1).alias("rn"), "day")
    return queue.join(days, ["week", "rn"], "left").select("week", "kind", "rn", "day")


sql("tx28_progress", "SELECT source, least(100, cast(floor(count(*) * 100.0 / 60) AS INTEGER)) AS percent FROM documents GROUP BY source".replace("INTEGER", "INT"), "SELECT source, least(100, CAST(floor(count(*) * 100.0 / 60) AS INTEGER)) AS percent FROM documents GROUP BY source")


@add("tx29_parse_int", "SELECT p_partkey, CAST(trunc(try_cast(replace(trim(v), ',', '') AS DOUBLE)) AS BIGINT) AS n FROM (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN ' 1,' || (100 + p_size) || ' ' WHEN 1 THEN p_size || '.9' WHEN 2 THEN 'n/a' ELSE '-' || p_size || '.5' END AS v FROM part)")
def tx29(spark, d):
    size = F.col("p_size").cast("string")
    kind = F.col("p_partkey") % 4
    v = F.when(kind == 0, F.concat(F.lit(" 1,"), (F.col("p_size") + 100).cast("string"), F.lit(" "))).when(kind == 1, F.concat(size, F.lit(".9"))).when(kind == 2, "n/a").otherwise(F.concat(F.lit("-"), size, F.lit(".5")))
    return table(spark, d, "part").select("p_partkey", texts.parse_int(v).alias("n"))


sql("tx30_shortened", "SELECT doc_id, md5(CASE WHEN length(text) > 500 THEN concat(substring(text, 1, 500), '... [cut]') ELSE text END) AS body FROM documents")


@add("tx31_template", "SELECT c_custkey, 'Hello ' || c_name || ',' || chr(10) || chr(10) || 'about ' || lower(c_mktsegment) AS body, len(string_split('Hello ' || c_name || ', about ' || lower(c_mktsegment), ' ')) < 6 AS fits FROM customer")
def tx31(spark, d):
    body = texts.fill(F.lit("Hello {{name}},\n\n\n\nabout {{topic}}"), {"name": F.col("c_name"), "topic": F.lower("c_mktsegment")})
    return table(spark, d, "customer").select("c_custkey", body.alias("body"), (F.size(F.split(body, "\\s+")) < 6).alias("fits"))


@add("tx32_row_ranges", "SELECT p_partkey, unnest(list_concat([p_size, p_size + 2], range(p_size + 4, p_size + 4 + p_partkey % 5 + 1))) AS n FROM part")
def tx32(spark, d):
    """The numbers of a specification a part, such as 7, 9,11-13."""
    spec = F.expr("concat(CAST(p_size AS STRING), ', ', CAST(p_size + 2 AS STRING), ' ,', CAST(p_size + 4 AS STRING), '-', CAST(p_size + 4 + p_partkey % 5 AS STRING))")
    return table(spark, d, "part").select("p_partkey", F.explode(texts.row_numbers(spec).cast("array<bigint>")).alias("n"))


sql("tx33_style_prefix", "SELECT p_partkey, CASE WHEN p_type LIKE 'STANDARD%' THEN 'standard' WHEN p_type LIKE 'SMALL%' THEN 'small' WHEN p_type LIKE 'PROMO%' THEN 'promo' ELSE 'other' END AS style FROM part")


#: Some area codes with their zones; a whole table is the caller's.
_AREAS = {"212": "America/New_York", "617": "America/New_York", "312": "America/Chicago", "713": "America/Chicago", "303": "America/Denver", "602": "America/Phoenix", "213": "America/Los_Angeles", "808": "Pacific/Honolulu"}
_AREA = "substr('212617312713303602213808999', CAST(1 + 3 * (c_custkey % 9) AS INT), 3)"
_SEVEN = "CAST(2000000 + c_custkey AS STRING)"
_RAW = f"CASE c_custkey % 4 WHEN 0 THEN concat('1 (', {_AREA}, ') ', {_SEVEN}) WHEN 1 THEN concat({_AREA}, '-', {_SEVEN}) WHEN 2 THEN concat('+1.', {_AREA}, '.', {_SEVEN}) ELSE concat('12', {_SEVEN}) END"


@add("tx34_phone", f"""SELECT c_custkey, '+1' || area || seven AS phone, area AS area_code, zone AS time_zone, CASE WHEN zone IN ('America/Los_Angeles', 'America/Denver', 'America/Phoenix') THEN 'morning' WHEN zone IN ('America/Chicago', 'America/New_York') THEN 'night' ELSE '' END AS calling_block
  FROM (SELECT c_custkey, {_AREA.replace('AS INT)', 'AS INTEGER)')} AS area, {_SEVEN.replace('STRING', 'VARCHAR')} AS seven FROM customer WHERE c_custkey % 4 <> 3) JOIN (VALUES {', '.join(f"('{a}', '{z}')" for a, z in _AREAS.items())}) v(code, zone) ON area = code""")
def tx34(spark, d):
    """The numbers that can be called, with zone and block; others give no row."""
    zones = spark.createDataFrame(list(_AREAS.items()), "area_code string, time_zone string")
    return texts.callable_phones(table(spark, d, "customer").select("c_custkey", F.expr(_RAW).alias("raw")), "raw", zones).drop("raw")


#: A table of one's own: a joined consonant with a code of two characters, others with one.
_CODES = [("क्ष", "x&"), *[(c, k) for c, k in zip("कखगघचछजझटठडढणतथदधनपफबभमयल", "BCDEGHIJKLMNOPQRSTUVWXYbcd", strict=False)]]
_SIGNED = "concat({0}, ' क्षि', {1}, 'ि र्', {2}, 'ी', substr({1}, 1, 1), '्', {2}, 'ि')"


def _signed(script) -> str:
    return _SIGNED.format(script("p_type"), script("p_brand"), script("p_name"))


_CODED = "regexp_replace(regexp_replace({}, '((?:.्)*.)ि', 'f\\1', 'g'), 'र्(.[ािीुूृेैोौं:ँॅ]*)', '\\1Z', 'g')"


@add("tx35_legacy_conversion", f"SELECT p_partkey, md5(translate(replace({_CODED.format(_signed(in_script))}, 'क्ष', 'x&'), 'कखगघचछजझटठडढणतथदधनपफबभमयल', 'BCDEGHIJKLMNOPQRSTUVWXYbcd')) AS coded, TRUE AS same FROM part")
def tx35(spark, d):
    """Texts in the script coded by a table and decoded again."""
    rows = table(spark, d, "part").select("p_partkey", F.expr(_signed(in_script)).alias("t"))
    coded = rows.withColumn("coded", legacy.encode(F.col("t"), _CODES, "f", "Z"))
    return coded.select("p_partkey", F.md5("coded").alias("coded"), (legacy.decode(F.col("coded"), _CODES, "f", "Z") == F.col("t")).alias("same"))


@add("tx36_video_id", "SELECT page_id, CASE WHEN page_id % 2 = 0 THEN lpad(CAST(page_id AS VARCHAR), 11, 'a') END AS video FROM pages")
def tx36(spark, d):
    vid = F.lpad(F.col("page_id").cast("string"), 11, "a")
    url = F.when(F.col("page_id") % 4 == 0, F.concat(F.lit("https://youtu.be/"), vid)).when(F.col("page_id") % 2 == 0, F.concat(F.lit("https://v.example/watch?v="), vid)).otherwise(F.col("url"))
    return table(spark, d, "pages").select("page_id", texts.video_id(url).alias("video"))


@add("tx37_domain", "SELECT page_id, split_part(regexp_replace(url, '^https?://(www\\.)?', ''), '/', 1) AS domain FROM pages")
def tx37(spark, d):
    return table(spark, d, "pages").select("page_id", texts.domain(F.col("url")).alias("domain"))


#: crc32 of a text of ASCII characters, bit by bit.
_CRC = """xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split({}, ''), lambda x: ascii(x)::UBIGINT)),
  lambda acc, x: list_reduce(list_prepend(xor(acc, x), range(8)::UBIGINT[]), lambda a, b: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384::UBIGINT) ELSE a // 2 END)), 4294967295::UBIGINT)"""
_SEED = _CRC.format("p_brand || '|' || p_type || '|' || p_size")


@add("tx38_crc_seed", f"SELECT p_partkey, CAST({_SEED} AS BIGINT) AS seed FROM part")
def tx38(spark, d):
    return table(spark, d, "part").select("p_partkey", F.crc32(F.encode(F.concat_ws("|", "p_brand", "p_type", F.col("p_size").cast("string")), "UTF-8")).alias("seed"))


@add("tx39_hook_closing", "SELECT doc_id, lines[1] AS hook, lines[len(lines)] AS closing FROM (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS lines FROM documents)")
def tx39(spark, d):
    return _docs(spark, d).select("doc_id", texts.first_line(F.col("text")).alias("hook"), texts.first_line(F.col("text"), last=True).alias("closing"))


@add("tx40_attribution", "SELECT doc_id, md5(regexp_replace(text, ' ?(Licensed under|This work is licensed)[^.]*[.]', '', 'g')) AS body FROM documents")
def tx40(spark, d):
    return _docs(spark, d).select("doc_id", F.md5(F.regexp_replace("text", " ?(Licensed under|This work is licensed)[^.]*[.]", "")).alias("body"))


@add("tx41_circular", "SELECT p_partkey, contains(lower(p_type), 'promo') OR length(trim(replace(lower(p_type), lower(p_brand), ''))) < 12 AS circular FROM part")
def tx41(spark, d):
    return table(spark, d, "part").select("p_partkey", texts.circular(F.col("p_type"), F.col("p_brand"), ["promo"]).alias("circular"))


sql("tx42_placeholder", "SELECT p_partkey, lower(trim(p_name)) IN ('a', 'b', 'c', 'd', 'none', 'n/a', '') OR length(trim(p_name)) < 2 AS placeholder FROM part")
