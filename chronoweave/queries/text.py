"""Text jobs, evaluation measures and streaming results."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from chronoweave.operators import text as X
from chronoweave.plans.stash import shared_dir
from chronoweave.registry import query
from chronoweave.streaming import jobs


_UNITS = "SELECT doc_id, text, unnest(range(0, greatest(CAST(ceil((length(text) - 128) / 64.0) AS INTEGER), 0) + 1)) AS i FROM documents WHERE length(text) > 0"


@query(f"""SELECT doc_id, CAST(i AS INTEGER) AS unit, CAST(i * 64 AS INTEGER) AS start, CAST(least(i * 64 + 128, length(text)) AS INTEGER) AS "end", md5(substr(text, i * 64 + 1, 128)) AS h FROM ({_UNITS}) x""")
def tx1_units(t):
    return X.units(t.documents, "doc_id", "text").select("doc_id", "unit", "start", "end", F.md5(F.encode("content", "utf-8")).alias("h"))


_SOURCES = "SELECT doc_id, text, CASE WHEN doc_id % 9 = 0 THEN 'no such words' WHEN doc_id % 4 = 0 THEN ' th' ELSE substr(text, 151, 40) END AS source FROM documents"


@query(f"""WITH f AS ({_SOURCES}), p AS (SELECT *, strpos(text, source) AS p FROM f), l AS (SELECT doc_id, source, CASE WHEN source IS NOT NULL AND length(source) > 0 AND p > 0 AND strpos(substr(text, p + 1), source) = 0 THEN p - 1 END AS s FROM p),
u AS (SELECT doc_id, i FROM ({_UNITS}) x)
SELECT l.doc_id, CAST(u.i AS INTEGER) AS unit, CASE WHEN u.i IS NULL THEN 'window_fallback' ELSE 'offset_overlap' END AS match_kind FROM l LEFT JOIN u ON u.doc_id = l.doc_id AND l.s < u.i * 64 + 128 AND u.i * 64 < l.s + length(l.source) WHERE l.doc_id IN (SELECT doc_id FROM documents)""")
def tx2_fn14_fact_units(t):
    source = F.when(F.col("doc_id") % 9 == 0, "no such words").when(F.col("doc_id") % 4 == 0, " th").otherwise(F.substring("text", 151, 40))
    facts = t.documents.select("doc_id", F.col("doc_id").alias("fact_id"), source.alias("source"))
    return X.fact_units(t.documents, facts, "doc_id", "text").select("doc_id", "unit", "match_kind")


_WINDOWS = """WITH RECURSIVE l AS (SELECT conv_id, turn, concat(upper(coalesce(role, '')), ': ', coalesce(text, '')) AS body, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r, length(concat('[Session: ', conv_id, ']')) + 2 AS head, length(concat(upper(coalesce(role, '')), ': ', coalesce(text, ''))) AS line FROM conversations),
w AS (SELECT conv_id, turn, r, head, 0::BIGINT AS win, CASE WHEN head + line > 600 THEN -(-line // (600 - head)) ELSE 1 END::BIGINT AS pieces, CASE WHEN head + line > 600 THEN head ELSE head + line + 2 END AS held, head + line <= 600 AS opened, CASE WHEN head + line > 600 THEN CAST(ceil(line / (600.0 - head)) AS BIGINT) ELSE 0 END AS nxt FROM l WHERE r = 1
UNION ALL SELECT l.conv_id, l.turn, l.r, l.head, CASE WHEN l.head + l.line > 600 THEN w.nxt + w.opened::INT WHEN w.opened AND w.held + l.line + 2 > 600 THEN w.nxt + 1 ELSE w.nxt END,
  CASE WHEN l.head + l.line > 600 THEN CAST(ceil(l.line / (600.0 - l.head)) AS BIGINT) ELSE 1 END,
  CASE WHEN l.head + l.line > 600 THEN l.head WHEN w.opened AND w.held + l.line + 2 > 600 THEN l.head + l.line + 2 ELSE w.held + l.line + 2 END,
  l.head + l.line <= 600,
  CASE WHEN l.head + l.line > 600 THEN w.nxt + w.opened::INT + CAST(ceil(l.line / (600.0 - l.head)) AS BIGINT) WHEN w.opened AND w.held + l.line + 2 > 600 THEN w.nxt + 1 ELSE w.nxt END
  FROM w JOIN l ON l.conv_id = w.conv_id AND l.r = w.r + 1)"""


@query(f"""{_WINDOWS}
SELECT w.conv_id, w.turn, w.win AS "window", CASE WHEN l.head + l.line > 600 THEN CAST(ceil(l.line / (600.0 - l.head)) AS BIGINT) ELSE 1 END AS pieces FROM w JOIN l ON l.conv_id = w.conv_id AND l.r = w.r""")
def tx3_turn_windows(t):
    return X.turn_windows(t.conversations, 600)


@query(f"""{_WINDOWS}, z AS (SELECT w.*, l.body, concat('[Session: ', w.conv_id, ']', chr(10), chr(10)) AS top, l.head + l.line > 600 AS big FROM w JOIN l ON l.conv_id = w.conv_id AND l.r = w.r)
SELECT conv_id, win AS "window", CAST(count(*) AS INTEGER) AS turns, md5(concat(min(top), string_agg(body, chr(10) || chr(10) ORDER BY r))) AS h FROM z WHERE NOT big GROUP BY 1, 2
UNION ALL SELECT conv_id, win + i, 1, md5(concat(top, substr(body, CAST(i * (600 - head) + 1 AS BIGINT), CAST(600 - head AS BIGINT)))) FROM (SELECT *, unnest(range(0, CAST(ceil(length(body) / (600.0 - head)) AS BIGINT))) AS i FROM z WHERE big) x""")
def tx3_window_texts(t):
    return X.window_texts(t.conversations, 600).select("conv_id", "window", "turns", F.md5(F.encode("content", "utf-8")).alias("h"))


@query("""WITH RECURSIVE s AS (SELECT doc_id, text, string_split(text, chr(10)) AS ps FROM documents WHERE text IS NOT NULL), l AS (SELECT doc_id, unnest(ps) AS p, unnest(range(1, len(ps) + 1)) AS r, len(ps) AS n FROM s WHERE length(text) > 800),
w AS (SELECT doc_id, r, n, CAST(NULL AS VARCHAR) AS done, p AS now, p AS last FROM l WHERE r = 1
UNION ALL SELECT l.doc_id, l.r, l.n, CASE WHEN w.now <> '' AND length(w.now) + length(l.p) + 1 > 800 THEN w.now END, CASE WHEN w.now <> '' AND length(w.now) + length(l.p) + 1 > 800 THEN CASE WHEN w.last <> '' THEN concat(w.last, chr(10), l.p) ELSE l.p END WHEN w.now <> '' THEN concat(w.now, chr(10), l.p) ELSE l.p END, l.p FROM w JOIN l ON l.doc_id = w.doc_id AND l.r = w.r + 1),
o AS (SELECT doc_id, r, done AS content FROM w WHERE done IS NOT NULL UNION ALL SELECT doc_id, r + 1, now FROM w WHERE r = n AND now <> '' UNION ALL SELECT doc_id, 0, text FROM s WHERE length(text) <= 800)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY r) - 1 AS INTEGER) AS piece, length(content) AS n, md5(content) AS h FROM o""")
def tx4_paragraphs(t):
    return X.paragraphs(t.documents, "doc_id", "text", 800, "\n", "\n").select("doc_id", "piece", F.length("content").alias("n"), F.md5(F.encode("content", "utf-8")).alias("h"))


@query("""WITH RECURSIVE s AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '') AS ps FROM documents WHERE text IS NOT NULL), l AS (SELECT doc_id, unnest(ps) AS p, unnest(range(1, len(ps) + 1)) AS r, len(ps) AS n FROM s),
h AS (SELECT *, length(p) < 50 AND regexp_matches(p, '^(Chapter|Letter|CHAPTER)\\s') AS head FROM l),
w AS (SELECT doc_id, r, n, CAST(NULL AS VARCHAR) AS done, p AS now FROM h WHERE r = 1
UNION ALL SELECT h.doc_id, h.r, h.n, CASE WHEN NOT h.head AND length(w.now) + length(h.p) >= 900 AND length(w.now) >= 120 THEN w.now END, CASE WHEN h.head OR length(w.now) + length(h.p) < 900 THEN concat(w.now, chr(10), chr(10), h.p) ELSE h.p END FROM w JOIN h ON h.doc_id = w.doc_id AND h.r = w.r + 1),
o AS (SELECT doc_id, r, done AS c FROM w WHERE done IS NOT NULL UNION ALL SELECT doc_id, r + 1, now FROM w WHERE r = n AND length(now) >= 120),
q AS (SELECT doc_id, row_number() OVER g - 1 AS piece, c, lag(c) OVER g AS before FROM o WINDOW g AS (PARTITION BY doc_id ORDER BY r)), k AS (SELECT *, CASE WHEN length(before) > 60 THEN right(before, 60) ELSE before END AS tail FROM q)
SELECT doc_id, CAST(piece AS INTEGER) AS piece, md5(CASE WHEN piece = 0 THEN c ELSE concat(CASE WHEN strpos(tail, ' ') > 1 THEN substr(tail, strpos(tail, ' ') + 1) ELSE tail END, chr(10), chr(10), c) END) AS h FROM k""")
def tx5_book_chunks(t):
    return X.book_chunks(t.documents, "doc_id", "text", 120, 900, 60, "\n").select("doc_id", "piece", F.md5(F.encode("content", "utf-8")).alias("h"))


_SAID = [" works at ", " is employed by ", " formerly for ", " is the CEO of ", " leads ", " reports to ", " lives in ", " is based in ", " moved to ", " knows ", " is friends with ", " met ", " is married to ", "'s spouse ", " built ", " founded ", " graduated from ", " attends "]
_SENTENCES = """
SELECT concat('d', CAST(doc_id AS VARCHAR(20))) AS id, text FROM documents
UNION ALL SELECT fact_id, concat(replace(s.canonical_name, '#', ' '), {verb}, replace(o.canonical_name, '#', ' '), '.')
FROM facts JOIN entities s ON s.entity_id = subject_id JOIN entities o ON o.entity_id = object_id"""
_VERB = "CASE CAST(substr(object_id, 2) AS BIGINT) % 18 " + " ".join(f"WHEN {i} THEN '{v.replace(chr(39), chr(39) * 2)}'" for i, v in enumerate(_SAID)) + " END"
_HITS = " UNION ALL ".join(
    f"SELECT id, {i} AS phrase, '{p}' AS predicate, '{h}' AS temporal_hint, " + ", ".join("unnest(regexp_extract_all(text, '{}', {})) AS {}".format(X.relation_pattern(f).replace("'", "''"), g, c) for g, c in ((0, "hit"), (1, "subject"), (2, "object"))) + ", unnest(range(len(regexp_extract_all(text, '{}')))) AS n FROM x".format(X.relation_pattern(f).replace("'", "''"))
    for i, (f, p, h) in enumerate(X.RELATIONS)
)


@query(f"""WITH x AS ({_SENTENCES.format(verb=_VERB)}), h AS ({_HITS}), r AS (SELECT *, row_number() OVER (PARTITION BY id, lower(subject), predicate, lower(object) ORDER BY phrase, n) AS r FROM h WHERE length(subject) >= 2 AND length(object) >= 2 AND lower(subject) NOT IN ('i', 'we', 'you', 'he', 'she', 'it', 'they'))
SELECT id, subject, predicate, object, temporal_hint, CAST(0.7 AS DOUBLE) AS confidence, substr(hit, 1, 100) AS source FROM r WHERE r = 1""")
def tx6_relations(t):
    """Typed relations in all documents and in the facts as sentences, each fact by one of the eighteen phrases."""
    verb = F.element_at(F.array(*[F.lit(v) for v in _SAID]), (F.substring("object_id", 2, 20).cast("long") % 18 + 1).cast("int"))
    name = lambda side: t.entities.select(F.col("entity_id").alias(side), F.replace("canonical_name", F.lit("#"), F.lit(" ")).alias(f"{side}_name"))
    facts = t.facts.select("fact_id", "subject_id", "object_id").join(name("subject_id"), "subject_id").join(name("object_id"), "object_id")
    said = facts.select(F.col("fact_id").alias("id"), F.concat("subject_id_name", verb, "object_id_name", F.lit(".")).alias("text"))
    texts = t.documents.select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), "text").unionByName(said)
    return X.best_relations(X.relations(texts, "id", "text"), "id")


_HAS = lambda marks: " OR ".join("contains(lower(text), '" + m.replace("'", "''") + "')" for m in marks)


@query(f"""SELECT doc_id, CASE WHEN {_HAS(X.LINK_MARKS)} THEN 'link' WHEN {_HAS(X.TASK_MARKS)} THEN 'task' WHEN {_HAS(X.QUESTION_MARKS)} THEN 'question' ELSE 'thought' END AS kind,
len(regexp_extract_all(text, 'https?://[^\\s<>"{{}}|\\\\^`\\[\\]]+')) AS urls, len(regexp_extract_all(text, '@([0-9A-Za-z_]+)')) AS mentions, len(regexp_extract_all(text, '#([0-9A-Za-z_]+)')) AS tags,
len(list_distinct(list_concat(list_concat(regexp_extract_all(text, '\\d{{4}}-\\d{{2}}-\\d{{2}}'), regexp_extract_all(text, '\\d{{1,2}}/\\d{{1,2}}/\\d{{2,4}}')), regexp_extract_all(text, '(?i)(today|tomorrow|yesterday|next week|last week|monday|tuesday|wednesday|thursday|friday|saturday|sunday)')))) AS dates,
len(list_filter(regexp_split_to_array(text, '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '')) AS words FROM documents""")
def tx7_content_types(t):
    marks = X.content_marks(F.col("text"))
    size = lambda c: F.size(marks[c]).cast("long").alias(c)
    return t.documents.select("doc_id", X.content_type(F.col("text")).alias("kind"), *[size(c) for c in ("urls", "mentions", "tags", "dates")], marks["words"].cast("long").alias("words"))


@query("""WITH m AS (SELECT doc_id, regexp_replace(text, '(?m)^([A-Z][^\\n]{0,60})$', '## \\1', 'g') AS text FROM documents WHERE text IS NOT NULL), l AS (SELECT doc_id, unnest(ls) AS content, unnest(range(len(ls))) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM m) x),
h AS (SELECT *, CASE WHEN regexp_matches(content, '^#{1,6}\\s+.+$') THEN line END AS spot FROM l), g AS (SELECT *, max(spot) OVER (PARTITION BY doc_id ORDER BY line) AS under FROM h)
SELECT g.doc_id, trim(regexp_replace(k.content, '^#+\\s+', ''), ' ') AS heading, count(*) AS lines FROM g LEFT JOIN l k ON k.doc_id = g.doc_id AND k.line = g.under WHERE g.spot IS NULL AND trim(g.content, ' ') <> '' GROUP BY 1, 2""")
def tx8_win9_sections(t):
    marked = t.documents.select("doc_id", F.regexp_replace("text", r"(?m)^([A-Z][^\n]{0,60})$", "## $1").alias("text"))
    return X.sections(marked, "doc_id", "text").groupBy("doc_id", "heading").agg(F.count("*").alias("lines"))


@query("""WITH m AS (SELECT doc_id, concat('---', chr(10), 'title: T', doc_id, chr(10), 'lang: ', coalesce(lang, '?'), chr(10), '---', chr(10), '# Head ', doc_id, chr(10), 'see [[Page ', doc_id % 7, '|x]] and [a](http://x/', doc_id, ') #tag', doc_id % 3, chr(10)) AS text FROM documents)
SELECT doc_id, concat('T', doc_id) AS title_key, concat('Head ', doc_id) AS title, concat('http://x/', doc_id) AS link, concat('Page ', doc_id % 7) AS wikilink, concat('tag', doc_id % 3) AS tag FROM m""")
def tx8_markdown_marks(t):
    head = F.concat(F.lit("---\ntitle: T"), "doc_id", F.lit("\nlang: "), F.coalesce("lang", F.lit("?")), F.lit("\n---\n# Head "), "doc_id", F.lit("\nsee [[Page "), F.col("doc_id") % 7, F.lit("|x]] and [a](http://x/"), "doc_id", F.lit(") #tag"), F.col("doc_id") % 3, F.lit("\n"))
    d = t.documents.select("doc_id", head.alias("text"))
    marks, pairs = X.markdown_marks(F.col("text")), X.front_matter(F.col("text"))[0]
    first = lambda c: F.element_at(marks[c], 1)
    return d.select("doc_id", F.element_at(F.filter(pairs, lambda p: p["key"] == "title"), 1)["value"].alias("title_key"), marks["title"].alias("title"), first("links").alias("link"), first("wikilinks").alias("wikilink"), first("tags").alias("tag"))


@query("""WITH c AS (SELECT conv_id, turn, regexp_replace(coalesce(text, ''), '[\\s]+', ' ', 'g') AS said, conv_id % 3 AS kind, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS r, coalesce(role, 'none') AS role FROM conversations)
SELECT conv_id, CASE kind WHEN 0 THEN 'vtt' WHEN 1 THEN 'srt' ELSE 'diarized' END AS format, CASE kind WHEN 0 THEN role WHEN 1 THEN 'Unknown' ELSE 'Speaker ' || upper(substr(role, 1, 1)) END AS speaker, count(*) AS segments, CAST(max(CASE WHEN kind < 2 THEN r * 2 + 1.5 END) AS DOUBLE) AS end_s FROM c WHERE trim(said) <> '' GROUP BY ALL""")
def tx9_transcripts(t):
    """Conversations written as captions of both formats or with named lines, and read back as segments."""
    at = lambda s: F.format_string("%02d:%02d:%02d", (s / 3600).cast("int"), (s % 3600 / 60).cast("int"), (s % 60).cast("int"))
    r = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1
    c = t.conversations.select("conv_id", "turn", F.coalesce("role", F.lit("none")).alias("role"), F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " ")).alias("said"), r.alias("r")).filter("said <> ''")
    start, kind = F.col("r") * 2, F.col("conv_id") % 3
    block = F.when(kind == 0, F.concat(at(start), F.lit(".000 --> "), at(start + 1), F.lit(".500\n<v "), "role", F.lit("> "), "said"))
    block = block.when(kind == 1, F.concat((F.col("r") + 1).cast("string"), F.lit("\n"), at(start), F.lit(",000 --> "), at(start + 1), F.lit(",500\n"), "said"))
    block = block.otherwise(F.concat(F.lit("Speaker "), F.upper(F.substring("role", 1, 1)), F.lit(": "), "said"))
    # one file a turn: a reader of whole conversations would hold each in one row
    found = X.transcript_segments(c.select("conv_id", block.alias("text")), "conv_id", "text")
    return found.groupBy("conv_id", "format", "speaker").agg(F.count("*").alias("segments"), F.max("end_s").alias("end_s"))


@query("""SELECT page_id, trim(regexp_extract(html, '(?is)<title>(.*?)</title>', 1)) AS title, regexp_extract(url, '^https?://([^/:?#]+)', 1) AS domain,
nullif(trim(regexp_extract(regexp_extract(html, '(?is)(<meta\\b[^>]*\\b(?:name|property)\\s*=\\s*["'']description["''][^>]*>)', 1), '(?is)\\bcontent\\s*=\\s*["'']([^"'']*)["'']', 1)), '') AS description FROM pages""")
def tx10_pages(t):
    return t.pages.select("page_id", X.page_title(F.col("html")).alias("title"), F.regexp_extract("url", r"^https?://([^/:?#]+)", 1).alias("domain"), X.page_meta(F.col("html"))["description"].alias("description"))


@query("""SELECT page_id, CAST(len(string_split(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\\b[^>]*>.*?</script>', ' ', 'g'), '(?is)<style\\b[^>]*>.*?</style>', ' ', 'g'), '(?is)<nav\\b[^>]*>.*?</nav>', ' ', 'g'), '(?is)<header\\b[^>]*>.*?</header>', ' ', 'g'), '(?is)<footer\\b[^>]*>.*?</footer>', ' ', 'g'), '(?is)<aside\\b[^>]*>.*?</aside>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'), ' '), ' ')) AS INTEGER) AS words FROM pages""")
def tx10_page_text(t):
    return t.pages.select("page_id", F.size(F.split(X.page_text(F.col("html")), " ")).alias("words"))


@query("SELECT doc_id, array_to_string(string_split(text, '. ')[1:3], '. ') AS summary FROM documents")
def tx11_first_sentences(t):
    return t.documents.select("doc_id", F.array_join(F.slice(F.split("text", r"\. "), 1, 3), ". ").alias("summary"))


_KIND = "CASE event_type WHEN 'view' THEN 'link' WHEN 'click' THEN 'task' WHEN 'purchase' THEN 'search' WHEN 'signup' THEN 'question' ELSE 'noise' END"


@query(f"""WITH i AS (SELECT user_id, type, greatest(0.0, least(1.0, c)) AS c FROM (SELECT user_id, {_KIND} AS type, max(value) / 400 AS c FROM events WHERE event_id % 3 = 0 GROUP BY 1, 2) x WHERE type <> 'noise'), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY c DESC, type) AS k FROM i), p AS (SELECT u.user_id, coalesce(CASE WHEN u.user_id % 2 = 0 THEN 'task' END, r.type, 'thought') AS p, coalesce(r.c, 0.5) AS top FROM (SELECT DISTINCT user_id FROM events WHERE event_id % 3 = 0) u LEFT JOIN r ON r.user_id = u.user_id AND k = 1)
SELECT user_id, p AS "primary", round(top, 6) AS top, CASE WHEN p = 'search' THEN 'search' WHEN user_id % 5 = 0 THEN 'process-link' ELSE concat('process-', p) END AS workflow FROM p""".replace("CASE WHEN p = 'search' THEN 'search' WHEN user_id % 5 = 0 THEN 'process-link'", "CASE WHEN user_id % 5 = 0 THEN 'process-link' WHEN p = 'search' THEN 'search'"))
def tx12_intents(t):
    """A user's kinds of events as a classification with unknown intents among them."""
    e = t.events.filter("event_id % 3 = 0").withColumn("type", F.expr(_KIND)).groupBy("user_id", "type").agg((F.max("value") / 400).alias("confidence"))
    rows = e.groupBy("user_id").agg(F.collect_list(F.struct("type", "confidence")).alias("intents"))  # the few kinds
    rows = rows.withColumns({"primary": F.when(F.col("user_id") % 2 == 0, "task").otherwise("nonsense"), "workflow": F.when(F.col("user_id") % 5 == 0, "process-link").otherwise("nonsense")})
    found = X.valid_intents(rows, "user_id")
    return found.select("user_id", "primary", F.round(F.element_at("intents", 1)["confidence"], 6).alias("top"), "workflow")


@query("""WITH r AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN ' short ' ELSE concat('send order ', o_orderkey) END AS a, lower(split_part(o_orderpriority, '-', 2)) AS p, CAST(o_totalprice AS DOUBLE) / 299999 AS c FROM orders), h AS (SELECT o_orderkey, trim(a) AS a, p, greatest(0.0, least(1.0, c)) AS c FROM r), w AS (SELECT *, CASE WHEN length(a) < 10 THEN 'too_short' WHEN c < 0.6 THEN 'low_confidence' END AS why FROM h)
SELECT o_orderkey, CASE WHEN why IS NULL THEN a ELSE '' END AS action, CASE WHEN why IS NOT NULL THEN 'low' WHEN p IN ('high', 'urgent') THEN 'high' WHEN p = 'low' THEN 'low' ELSE 'medium' END AS priority, round(CASE WHEN why = 'too_short' THEN 0.0 ELSE c END, 6) AS confidence, why AS rejection FROM w""")
def tx13_tasks(t):
    action = F.when(F.col("o_orderkey") % 7 == 0, " short ").otherwise(F.concat(F.lit("send order "), F.col("o_orderkey").cast("string")))
    rows = t.orders.select("o_orderkey", action.alias("action"), F.substring_index("o_orderpriority", "-", -1).alias("priority"), (F.col("o_totalprice").cast("double") / 299999).alias("confidence"))
    return X.valid_tasks(rows, "o_orderkey").withColumn("confidence", F.round("confidence", 6))


@query("SELECT event_id, CASE WHEN event_type IN ('view', 'click') THEN event_type ELSE 'other' END AS type, round(greatest(0.0, least(1.0, value / 100)), 6) AS confidence FROM events")
def tx14_mentions(t):
    rows = t.events.select("event_id", F.upper("event_type").alias("type"), (F.col("value") / 100).alias("confidence"))
    return X.valid_mentions(rows, ["view", "click"]).withColumn("confidence", F.round("confidence", 6))


_SWEEP = " UNION ALL ".join(f"SELECT {size} AS config, doc_id, i AS unit, i * {size // 2} AS st, least(i * {size // 2} + {size}, n) AS en, substr(text, i * {size // 2} + 1, {size}) AS c FROM (SELECT doc_id, text, length(text) AS n, unnest(range(0, greatest(CAST(ceil((length(text) - {size}) / {size / 2}) AS INTEGER), 0) + 1)) AS i FROM documents WHERE length(text) > 0) x{size}" for size in (128, 256))


@query(f"""WITH u AS MATERIALIZED ({_SWEEP}), n AS MATERIALIZED (SELECT doc_id AS needle, doc_id, 40 AS a, 90 AS z, substr(text, 41, 50) AS q FROM documents WHERE doc_id % 20 = 0 AND length(text) >= 200), w AS MATERIALIZED (SELECT DISTINCT needle, unnest(string_split(q, ' ')) AS w FROM n), k AS (SELECT needle, count(*) AS n FROM w GROUP BY 1),
x AS MATERIALIZED (SELECT DISTINCT config, doc_id, unit, unnest(string_split(c, ' ')) AS w FROM u), s AS (SELECT config, needle, doc_id, unit, count(*)::DOUBLE / k.n AS score FROM w JOIN x USING (w) JOIN k USING (needle) GROUP BY config, needle, doc_id, unit, k.n), r AS (SELECT *, row_number() OVER (PARTITION BY config, needle ORDER BY score DESC, doc_id, unit) AS rank FROM s),
g AS (SELECT config, needle, u.doc_id, unit FROM n JOIN u ON u.doc_id = n.doc_id WHERE greatest(0, least(en, z) - greatest(st, a)) >= 50), b AS (SELECT config, needle, min(rank) AS rank, max(score) AS score FROM r JOIN g USING (config, needle, doc_id, unit) WHERE rank <= 50 GROUP BY 1, 2)
SELECT config, count(*) AS needles, round(avg(coalesce(rank <= 1, false)::INT), 6) AS recall_1, round(avg(coalesce(rank <= 3, false)::INT), 6) AS recall_3, round(avg(coalesce(rank <= 5, false)::INT), 6) AS recall_5, round(avg(score), 6) AS mean_score FROM (SELECT DISTINCT config, needle FROM g) q LEFT JOIN b USING (config, needle) GROUP BY 1""")
def ev3_unit_sweep(t):
    """Two unit sizes against needles of the stated queries' documents, ranked by the share of a needle's words."""
    d = t.documents.select("doc_id", "text")
    cut = [X.units(d, "doc_id", "text", size, size // 2).withColumn("config", F.lit(size)) for size in (128, 256)]
    u = cut[0].unionByName(cut[1])
    n = d.filter("doc_id % 20 = 0 and length(text) >= 200").select(F.col("doc_id").alias("needle"), "doc_id", F.lit(40).alias("first"), F.lit(90).alias("last"), F.substring("text", 41, 50).alias("q"))
    gold = X.needle_units(n.drop("q"), u.drop("content"), "doc_id")
    ranked = X.gold_ranks(n.select("needle", F.array_distinct(F.split("q", " ")).alias("asked")), u.select("config", "doc_id", "unit", F.array_distinct(F.split("content", " ")).alias("held")), gold)
    return X.sweep_scores(ranked.filter("rank <= 50"), gold, ["doc_id", "unit"])


@query("""WITH p AS (SELECT doc_id, quality = 1 AS truth, length(text) > 300 AS guess FROM labels JOIN documents USING (doc_id))
SELECT round(sum((truth AND guess)::INT)::DOUBLE / sum(truth::INT), 6) AS recall, round(sum((truth AND guess)::INT)::DOUBLE / sum(guess::INT), 6) AS precision FROM p""")
def ev1_recall_precision(t):
    p = t.labels.join(t.documents.select("doc_id", (F.length("text") > 300).alias("guess")), "doc_id").withColumn("truth", F.col("quality") == 1)
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    hit = n(F.col("truth") & F.col("guess"))
    return p.agg(F.round(hit / F.nullif(n(F.col("truth")), F.lit(0)), 6).alias("recall"), F.round(hit / F.nullif(n(F.col("guess")), F.lit(0)), 6).alias("precision"))


@query("SELECT round(avg(coalesce(1.0 / r, 0)), 6) AS mrr FROM (SELECT user_id, min(CASE WHEN event_type = 'purchase' THEN k END) AS r FROM (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS k FROM events) x GROUP BY 1) y")
def ev2_mrr(t):
    k = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("value"), "event_id"))
    first = t.events.withColumn("k", k).groupBy("user_id").agg(F.min(F.when(F.col("event_type") == "purchase", F.col("k"))).alias("r"))
    return first.agg(F.round(F.avg(F.coalesce(1.0 / F.col("r"), F.lit(0.0))), 6).alias("mrr"))


@query("SELECT source, count(*) AS n, round(avg(quality), 6) AS accuracy, round(avg(toxic), 6) AS abstained FROM labels JOIN documents USING (doc_id) GROUP BY 1")
def ev4_category_accuracy(t):
    return t.labels.join(t.documents.select("doc_id", "source"), "doc_id").groupBy("source").agg(F.count("*").alias("n"), F.round(F.avg("quality"), 6).alias("accuracy"), F.round(F.avg("toxic"), 6).alias("abstained"))


@query("""SELECT x AS threshold, round(2.0 * sum((n_chars >= x AND quality = 1)::INT) / (sum((n_chars >= x)::INT) + sum(quality)), 6) AS f1 FROM labels JOIN documents USING (doc_id), (SELECT unnest([100, 500, 1000]) AS x) t GROUP BY 1""")
def ev8_threshold_calibration(t):
    rows = t.labels.join(t.documents.select("doc_id", "n_chars"), "doc_id").withColumn("threshold", F.explode(F.array(*map(F.lit, (100, 500, 1000)))))
    over = F.col("n_chars") >= F.col("threshold")
    f1 = 2.0 * F.sum(F.when(over & (F.col("quality") == 1), 1).otherwise(0)) / (F.sum(F.when(over, 1).otherwise(0)) + F.sum("quality"))
    return rows.groupBy("threshold").agg(F.round(f1, 6).alias("f1"))


@query("SELECT 'orders' AS name, count(*) > 0 AS rows_ok, count(*) = count(DISTINCT o_orderkey) AS unique_ok, min(o_totalprice) > 0 AS range_ok FROM orders")
def ev9_data_checks(t):
    return t.orders.agg(F.lit("orders").alias("name"), (F.count("*") > 0).alias("rows_ok"), (F.count("*") == F.count_distinct("o_orderkey")).alias("unique_ok"), (F.min("o_totalprice") > 0).alias("range_ok"))


@query("SELECT doc_id, greatest(CAST(ceil((length(text) - 128) / 64.0) AS INTEGER), 0) + 1 AS units FROM documents WHERE length(text) > 0")
def st1_streamed_units(t):
    """Documents taken as a stream of files, split and appended; the table that the stream wrote."""
    base = f"{shared_dir(t.spark)}/stream-{uuid.uuid4().hex}"
    stream = t.spark.readStream.schema(t.documents.schema).option("pathGlobFilter", "*.parquet").parquet(f"{t.folder}/documents.parquet*")
    jobs.ingest_units(stream, f"{base}/units", f"{base}/checkpoint").awaitTermination()
    found = t.spark.read.parquet(f"{base}/units")
    return found.groupBy("doc_id").agg(F.count("*").cast("int").alias("units"))


@query("""WITH e AS MATERIALIZED (SELECT event_type, ts, time_bucket(INTERVAL 1 HOUR, ts) AS start, event_id % 50 = 0 AS late FROM events), w AS (SELECT (SELECT max(ts) FROM e WHERE NOT late) - INTERVAL 10 MINUTE AS w1, (SELECT max(ts) FROM e) - INTERVAL 10 MINUTE AS w2)
SELECT start, event_type, count(*) AS n FROM e, w WHERE start + INTERVAL 1 HOUR <= w2 AND (NOT late OR start + INTERVAL 1 HOUR > w1) GROUP BY 1, 2""")
def st6_event_windows(t):
    """Windows that a stream closes; one event in fifty arrives after all others, and counts only where its window is open.

    The stream stops and starts again from its checkpoint before the late events come.
    """
    base, events = f"{shared_dir(t.spark)}/stream-{uuid.uuid4().hex}", t.events.withColumn("ts", F.col("ts").cast("timestamp"))
    for late in (False, True):
        events.filter((F.col("event_id") % 50 == 0) == late).write.mode("append").parquet(f"{base}/in")
        found = jobs.event_counts(jobs.read_folder(t.spark, f"{base}/in", events.schema, 100_000), "1 hour", "10 minutes")
        found.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return t.spark.read.schema(found.schema).parquet(f"{base}/out").withColumn("start", F.col("start").cast("timestamp_ntz"))
