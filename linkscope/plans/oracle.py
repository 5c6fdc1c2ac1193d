"""DuckDB SQL for the registered queries, over the same views of the driver's tables."""

from __future__ import annotations

from linkscope.config import TEXT_STOP_WORDS, TITLE_STOP_WORDS
from linkscope.operators.rerank import ASKED

POSTS = """posts AS (
  SELECT k AS id, CASE WHEN k % 11 = 3 THEN 'draft' WHEN k % 23 = 5 THEN 'trash' WHEN k % 29 = 7 THEN 'private' WHEN type = 'attachment' THEN 'inherit' ELSE 'publish' END AS status,
         type, 'Post ' || k AS title, o_orderpriority AS content, o_orderdate AS post_date, o_custkey % 25 AS category_id, o_orderpriority = '1-URGENT' AS is_sticky,
         CASE WHEN k % 19 = 0 THEN CAST(floor(o_totalprice / 1000) AS BIGINT) END AS pageviews, CASE WHEN type = 'attachment' AND k % 3 = 0 THEN k - 1 ELSE 0 END AS parent_id, k % 37 = 1 AS has_password
  FROM (SELECT *, o_orderkey AS k, CASE WHEN o_orderkey % 7 = 0 THEN 'page' WHEN o_orderkey % 13 = 0 THEN 'product' WHEN o_orderkey % 17 = 0 THEN 'attachment' ELSE 'post' END AS type FROM orders)
  WHERE k % 101 <> 13)"""
LINKS = "links AS (SELECT l_orderkey AS source_post_id, l_partkey * 7 + l_suppkey AS target_post_id, l_linenumber AS pos, '/post-' || (l_partkey * 7 + l_suppkey) || '/' AS link_url FROM lineitem)"
SCOPED = "scoped AS (SELECT * FROM posts WHERE status = 'publish' AND type IN ('post', 'page') AND category_id NOT IN (3, 4))"
COUNTS = """inb AS (SELECT target_post_id AS post_id, count(*) AS inbound_count FROM links WHERE source_post_id <> target_post_id GROUP BY 1),
outb AS (SELECT source_post_id AS post_id, count(*) AS outbound_count FROM links GROUP BY 1)"""
STATS = """stats AS (
  SELECT id AS post_id, coalesce(inbound_count, 0) AS inbound_count, coalesce(outbound_count, 0) AS outbound_count,
         floor((greatest(1.0::DOUBLE, date_diff('second', post_date, TIMESTAMP '2001-08-15 00:00:00') / 86400.0::DOUBLE) / 30.0::DOUBLE) * (1.0::DOUBLE / (coalesce(inbound_count, 0) + 1))
               * CASE WHEN coalesce(pageviews, 0) > 100 THEN 2.0::DOUBLE WHEN is_sticky THEN 1.5::DOUBLE ELSE 1.0::DOUBLE END * 100.0::DOUBLE + 0.5::DOUBLE) / 100.0::DOUBLE AS orphan_score
  FROM posts LEFT JOIN inb ON id = inb.post_id LEFT JOIN outb ON id = outb.post_id
  WHERE status = 'publish' AND type IN ('post', 'page') AND (category_id NOT IN (3, 4) OR inbound_count IS NOT NULL OR outbound_count IS NOT NULL))"""
SUGGESTIONS = """suggestions AS (
  SELECT l_orderkey * 10 + l_linenumber AS id, l_orderkey AS source_post_id, l_partkey * 7 + l_suppkey AS target_post_id, CASE WHEN l_linestatus = 'O' THEN 'high' ELSE 'specified' END AS keyword,
         l_quantity + l_discount AS relevance_score, CASE WHEN l_returnflag = 'N' THEN 'pending' WHEN l_returnflag = 'A' THEN 'applied' ELSE 'dismissed' END AS status FROM lineitem)"""
BROKEN = """broken AS (
  SELECT l.*, sp.title AS source_title, tp.title AS target_title, CASE WHEN tp.status = 'inherit' AND tp.type = 'attachment' THEN pp.status ELSE tp.status END AS target_status
  FROM links l JOIN posts sp ON sp.id = l.source_post_id LEFT JOIN posts tp ON tp.id = l.target_post_id LEFT JOIN posts pp ON tp.parent_id > 0 AND pp.id = tp.parent_id
  WHERE (tp.id IS NULL OR tp.status NOT IN ('publish', 'private'))
    AND NOT coalesce(tp.status = 'inherit' AND tp.type = 'attachment' AND (coalesce(tp.parent_id, 0) = 0 OR pp.id IS NULL OR pp.status IN ('publish', 'private')), false))"""
STOP = ", ".join(f"'{w}'" for w in TEXT_STOP_WORDS)
TOKENS = f"""tok AS (
  SELECT doc_id, list_filter(string_split(trim(regexp_replace(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' '), lambda w: length(w) > 2 AND w NOT IN ({STOP})) AS tokens FROM documents)"""
WEIGHTS = """tf AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(tokens) AS n, unnest(tokens) AS term FROM tok) GROUP BY 1, 2, 3),
df AS (SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct(tokens)) AS term FROM tok) GROUP BY 1),
wt AS (SELECT doc_id, term, tf, df, (tf::DOUBLE / n::DOUBLE) * (ln((1 + (SELECT count(*) FROM documents))::DOUBLE / (1 + df)::DOUBLE) + 1.0) AS weight FROM tf JOIN df USING (term))"""
DOCS = """docs AS (
  SELECT doc_id, text, source AS category, array_to_string(list_slice(string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' '), 1, 5), ' ') AS title, doc_id % 120 AS age_days FROM documents)"""
#: Pairs of neighbouring documents, and each source with its three successors.
PAIRS = "pairs AS (SELECT a.doc_id AS a, b.doc_id AS b FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1)"
POOLS = "pool AS (SELECT a.doc_id AS source, b.doc_id AS target FROM documents a JOIN documents b ON b.doc_id BETWEEN a.doc_id + 1 AND a.doc_id + 3)"
BATCH = """mem AS (SELECT source, target AS doc_id FROM pool UNION ALL SELECT DISTINCT source, source FROM pool),
sized AS (SELECT source, count(*) AS pool FROM mem GROUP BY 1),
bdf AS (SELECT source, term, count(*) AS df FROM (SELECT source, unnest(list_distinct(tokens)) AS term FROM mem JOIN tok USING (doc_id)) GROUP BY 1, 2),
btf AS (SELECT source, doc_id, n, term, count(*) AS tf FROM (SELECT source, doc_id, len(tokens) AS n, unnest(tokens) AS term FROM mem JOIN tok USING (doc_id)) GROUP BY 1, 2, 3, 4),
bw AS (SELECT source, doc_id, term, (tf::DOUBLE / n::DOUBLE) * (ln((1 + pool)::DOUBLE / (1 + df)::DOUBLE) + 1.0) AS w FROM btf JOIN bdf USING (source, term) JOIN sized USING (source)),
bn AS (SELECT source, doc_id, sqrt(sum(w * w)) AS norm FROM bw GROUP BY 1, 2),
bd AS (SELECT x.source, x.doc_id AS target, sum(x.w * y.w) AS dot FROM bw x JOIN bw y ON y.source = x.source AND y.doc_id = x.source AND y.term = x.term WHERE x.doc_id <> x.source GROUP BY 1, 2),
bs AS (SELECT p.source, p.target, CASE WHEN coalesce(dot, 0) = 0 THEN 0.0::DOUBLE ELSE least(1.0::DOUBLE, dot / (s.norm * t.norm)) END AS cosine
  FROM pool p LEFT JOIN bd ON bd.source = p.source AND bd.target = p.target LEFT JOIN bn s ON s.source = p.source AND s.doc_id = p.source LEFT JOIN bn t ON t.source = p.source AND t.doc_id = p.target)"""
HEUR = """heur AS (
  SELECT source, target, keyword, round(CASE WHEN lower(trim(keyword)) = lower(trim(t.title)) THEN 1.5::DOUBLE ELSE 1.0::DOUBLE END * (1.0::DOUBLE + 0.1::DOUBLE * len(regexp_extract_all(keyword, '[A-Za-z][A-Za-z''-]*')))
    * CASE WHEN t.age_days < 30 THEN 1.2::DOUBLE WHEN t.age_days < 90 THEN 1.1::DOUBLE ELSE 1.0::DOUBLE END * CASE WHEN s.category = t.category THEN 1.3::DOUBLE ELSE 1.0::DOUBLE END, 2) AS heuristic
  FROM (SELECT *, array_to_string(list_slice(string_split((SELECT title FROM docs d WHERE d.doc_id = target), ' '), 1, 3), ' ') AS keyword FROM pool) JOIN docs s ON s.doc_id = source JOIN docs t ON t.doc_id = target)"""
HREFS = """hrefs AS (
  SELECT page_id AS source_id, url AS base, generate_subscripts(l, 1) AS pos, unnest(l) AS href, unnest(t) AS anchor
  FROM (SELECT page_id, url, regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1) AS l, regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 2) AS t FROM pages))"""
RESOLVED = "res AS (SELECT *, lower(regexp_extract(base, '^([^:]+)://', 1)) || '://' || lower(regexp_extract(base, '://([^/?#]*)', 1)) || regexp_extract(href, '^[^#]*') AS url FROM hrefs)"


def w(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


#: The tables after the changes of lifecycle_stats: the links of posts that were in scope before and did not change, and those found anew.
LATER = (
    POSTS.replace("posts AS", "posts0 AS", 1),
    LINKS.replace("links AS", "links0 AS", 1),
    "posts AS (SELECT * REPLACE (CASE WHEN id % 10 = 2 THEN 'trash' WHEN id % 10 = 5 THEN 'publish' ELSE status END AS status) FROM posts0 WHERE id % 10 <> 4)",
    SCOPED,
    SCOPED.replace("scoped AS", "scoped0 AS", 1).replace("FROM posts", "FROM posts0"),
    """links AS (
  SELECT * FROM links0 WHERE source_post_id % 10 NOT IN (1, 2, 4, 5) AND source_post_id IN (SELECT id FROM scoped0)
  UNION ALL SELECT * FROM links0 WHERE (source_post_id % 10 = 1 AND pos <= 2 OR source_post_id % 10 = 5) AND source_post_id IN (SELECT id FROM scoped))""",
    COUNTS,
    STATS,
)
PAGES = """posts AS (
  SELECT page_id AS id, CASE WHEN page_id % 5 = 3 THEN 'draft' WHEN page_id % 7 = 2 THEN 'inherit' ELSE 'publish' END AS status, trim(regexp_extract(html, '<a href="/([^"]*)"', 1), '/') AS path FROM pages)"""
def _clip(text: str, chars: int) -> str:
    flat = f"trim(regexp_replace(coalesce({text}, ''), '\\s+', ' ', 'g'))"
    return f"CASE WHEN length({flat}) > {chars} THEN substr({flat}, 1, {chars}) || '…' ELSE {flat} END"


#: The words of a title with the punctuation round them, and by a condition the runs of adjacent words.
WORDS = r"""heads AS (SELECT doc_id, regexp_replace(title, '[\s?!.,;:…]+$', '') AS head FROM docs),
cores AS (
  SELECT doc_id, i, core, core <> '' AND regexp_matches(word, '^[^\p{L}\p{N}]') AS opens, core <> '' AND regexp_matches(word, '[^\p{L}\p{N}]$') AS closes
  FROM (SELECT *, regexp_replace(regexp_replace(word, '^[^\p{L}\p{N}]+', ''), '[^\p{L}\p{N}]+$', '') AS core
  FROM (SELECT doc_id, unnest(string_split(head, ' ')) AS word, generate_subscripts(string_split(head, ' '), 1) AS i FROM heads)))"""


def runs(stays: str) -> str:
    before = "coalesce(sum(CASE WHEN stays AND closes THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)"
    cut = "sum(CASE WHEN NOT stays OR opens THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i)"
    return f"runs AS (SELECT * FROM (SELECT doc_id, i, core, stays, {cut} + {before} AS run FROM (SELECT *, {stays} AS stays FROM cores)) WHERE stays)"


def _edge(word: str) -> str:
    return f"length({word}) >= 3 AND lower({word}) NOT IN ({STOP})"


def plain(html: str) -> str:
    """The text that may hold a link, of the tags that the pages use."""
    for pattern, by in (
        (r"(?is)<script\b[^>]*>.*?</script>", " "),
        (r"(?is)<style\b[^>]*>.*?</style>", " "),
        (r"(?s)<!--.*?-->", ""),
        (r"(?is)<h1\b[^>]*>.*?</h1>", " "),
        (r"(?i)</?(a|b)\b[^>]*>", ""),
        (r"(?i)</?[a-z!][^>]*>", " "),
        (r"[^\s@]+@[^\s@]+", " "),
        (r"[ \t\r\n]+", " "),
    ):
        html = f"regexp_replace({html}, '{pattern}', '{by}', 'g')"
    return f"trim({html})"


#: What is passed over on the way to the place of a link: elements without links, tags; then the keyword between other characters than word ones.
SKIP = r"<(?:script|style|title|h1|a)\b[^>]*>.*?</(?:script|style|title|h1|a)>|<!--.*?-->|</?(?:!doctype|html|head|meta|body|nav|ul|li|div|p|b|br|article|footer)\b[^>]*>"
PLACES = rf"""places AS (
  SELECT page_id, html, keyword, '(?is)^((?:{SKIP}|[^<])*?(?:{SKIP.replace("!doctype", "html")}|[^\p{{L}}\p{{N}}\p{{M}}_&<]))(' || keyword || ')([^\p{{L}}\p{{N}}\p{{M}}_]|$)' AS place
  FROM (SELECT page_id, html, regexp_extract(html, '<p>[^<]*?([A-Za-z]{{4,}})', 1) AS keyword FROM pages))"""
CONTEXTS = rf"""marked AS (SELECT page_id, keyword, CASE WHEN keyword <> '' AND regexp_matches(html, place) THEN {plain("regexp_replace(html, place, '" + chr(92) + "1' || chr(57344) || '" + chr(92) + "2' || chr(57345) || '" + chr(92) + "3')")} END AS text FROM places),
cut AS (SELECT page_id, keyword, text, instr(text, chr(57344)) - 1 AS pos, instr(text, chr(57345)) - 1 AS stop, replace(replace(text, chr(57344), ''), chr(57345), '') AS bare FROM marked),
part AS (SELECT *, substr(bare, greatest(0, pos - 100) + 1, stop - pos - 1 + 200) AS raw FROM cut),
led AS (SELECT *, CASE WHEN pos <= 100 THEN raw WHEN instr(raw, ' ') BETWEEN 1 AND 20 THEN '...' || substr(raw, instr(raw, ' ') + 1) ELSE '...' || raw END AS lead_in FROM part),
ended AS (SELECT *, CASE WHEN length(regexp_extract(lead_in, '(?s)^(.*) ', 1)) > length(lead_in) - 20 THEN regexp_extract(lead_in, '(?s)^(.*) ', 1) ELSE lead_in END AS body FROM led)"""
GRAPH = (POSTS, LINKS, SCOPED, COUNTS, STATS)
SQL = {
    "in_scope_posts": w(POSTS, SCOPED) + "SELECT id, status, type FROM scoped",
    "suggestion_sources": w(POSTS, SCOPED) + "SELECT id FROM scoped WHERE NOT has_password",
    "prune_index": w(POSTS, LINKS, SCOPED) + "SELECT * FROM links WHERE source_post_id IN (SELECT id FROM scoped)",
    "outbound_counts": w(LINKS, COUNTS) + "SELECT * FROM outb",
    "inbound_counts": w(LINKS, COUNTS) + "SELECT * FROM inb",
    "linking_sources": w(POSTS, LINKS) + "SELECT DISTINCT source_post_id FROM links WHERE target_post_id IN (SELECT id FROM posts WHERE status = 'draft')",
    "post_type_labels": w(POSTS) + "SELECT id, CASE type WHEN 'post' THEN 'Post' WHEN 'page' THEN 'Page' WHEN 'attachment' THEN 'Media' ELSE type END AS label FROM posts",
    "affected_posts": w(*GRAPH) + "SELECT source_post_id AS post_id FROM links UNION SELECT target_post_id FROM links UNION SELECT post_id FROM stats",
    "orphan_scores": w(*GRAPH) + "SELECT * FROM stats",
    "orphan_priority": w(*GRAPH) + "SELECT post_id, CASE WHEN orphan_score > 5 THEN 'high' WHEN orphan_score > 2 THEN 'medium' ELSE 'low' END AS priority FROM stats",
    "orphan_posts": w(*GRAPH)
    + "SELECT post_id, title, type, orphan_score, CASE WHEN orphan_score > 5 THEN 'high' WHEN orphan_score > 2 THEN 'medium' ELSE 'low' END AS priority FROM stats JOIN scoped ON id = post_id WHERE inbound_count = 0 ORDER BY orphan_score DESC, post_id LIMIT 50",
    "low_outbound_posts": w(*GRAPH) + "SELECT post_id, title, outbound_count FROM stats JOIN scoped ON id = post_id WHERE outbound_count <= 2 ORDER BY outbound_count, post_date DESC, post_id LIMIT 50",
    "top_linked_posts": w(*GRAPH) + "SELECT post_id, title, inbound_count FROM stats JOIN posts ON id = post_id AND status = 'publish' WHERE inbound_count > 0 ORDER BY inbound_count DESC, post_id LIMIT 20",
    "count_orphans": w(*GRAPH) + "SELECT count(*) AS n FROM stats JOIN scoped ON id = post_id WHERE inbound_count = 0",
    "count_low_outbound": w(*GRAPH) + "SELECT count(*) AS n FROM stats JOIN scoped ON id = post_id WHERE outbound_count <= 2",
    "summary": w(*GRAPH, SUGGESTIONS, BROKEN)
    + """SELECT count(*) AS total_posts, count(*) FILTER (inbound_count = 0) AS orphan_posts, count(*) FILTER (outbound_count <= 2) AS low_outbound, round(round(avg(inbound_count), 4), 1) AS avg_inbound,
  round(round(avg(outbound_count), 4), 1) AS avg_outbound, (SELECT count(*) FROM links) AS total_links, (SELECT count(*) FROM broken) AS broken_links,
  (SELECT count(*) FROM suggestions WHERE status = 'pending' AND source_post_id IN (SELECT id FROM scoped) AND target_post_id IN (SELECT id FROM scoped)) AS pending_suggestions FROM stats JOIN scoped ON id = post_id""",
    "report_totals": w(*GRAPH)
    + "SELECT report, least(total, 100) AS shown, total FROM (SELECT 'orphans' AS report, count(*) AS total FROM stats JOIN scoped ON id = post_id WHERE inbound_count = 0 UNION ALL SELECT 'low_outbound', count(*) FROM stats JOIN scoped ON id = post_id WHERE outbound_count <= 2)",
    "link_badge": w(*GRAPH) + "SELECT post_id, '↓' || inbound_count || ' ↑' || outbound_count AS badge FROM stats",
    "post_links": w(POSTS, LINKS) + "SELECT source_post_id, pos, target_post_id, title AS target_title, status AS target_status FROM links JOIN posts ON id = target_post_id",
    "inbound_links": w(POSTS, LINKS) + "SELECT target_post_id, source_post_id, pos, title AS source_title FROM links JOIN posts ON id = source_post_id",
    "broken_links": w(POSTS, LINKS, BROKEN)
    + """SELECT source_post_id, pos, target_post_id, link_url, source_title, target_title, target_status,
  CASE coalesce(target_status, '') WHEN '' THEN 'Deleted' WHEN 'publish' THEN 'Published' WHEN 'draft' THEN 'Draft' WHEN 'trash' THEN 'Trashed' WHEN 'private' THEN 'Private' ELSE target_status END AS target_label FROM broken""",
    "pending_suggestions": w(POSTS, SCOPED, SUGGESTIONS)
    + "SELECT g.id, source_post_id, target_post_id, s.title AS source_title, t.title AS target_title, relevance_score FROM suggestions g JOIN scoped s ON s.id = source_post_id JOIN scoped t ON t.id = target_post_id WHERE g.status = 'pending' ORDER BY relevance_score DESC, g.id LIMIT 50",
    "apply_outcome": w(POSTS, SCOPED, SUGGESTIONS)
    + """SELECT id, outcome, CASE WHEN outcome = 'ok' THEN regexp_replace(content, '(?i)' || keyword, '<a href="https://example.test/post-' || target_post_id || '/">' || regexp_extract(content, '(?i)' || keyword) || '</a>') END AS new_content
  FROM (SELECT g.id, g.keyword, g.target_post_id, s.content, CASE WHEN g.status <> 'pending' THEN 'not_pending' WHEN source_post_id = target_post_id THEN 'same_post' WHEN s.id IS NULL OR t.id IS NULL THEN 'post_missing'
  WHEN s.id NOT IN (SELECT id FROM scoped) OR t.id NOT IN (SELECT id FROM scoped) THEN 'out_of_scope'
  WHEN NOT coalesce(regexp_matches(s.content, '(?i)(^|[^\\p{L}\\p{N}\\p{M}_&])' || keyword || '($|[^\\p{L}\\p{N}\\p{M}_])'), false) THEN 'keyword_missing' ELSE 'ok' END AS outcome
  FROM suggestions g LEFT JOIN posts s ON s.id = source_post_id LEFT JOIN posts t ON t.id = target_post_id)""",
    "unpublished_targets": w(POSTS, LINKS) + "SELECT 'https://example.test' || link_url AS url, min(id) AS target_id FROM (SELECT DISTINCT link_url, target_post_id FROM links) JOIN posts ON id = target_post_id WHERE status IN ('draft', 'pending', 'future', 'trash') GROUP BY 1",
    "carried_targets": w(POSTS, LINKS)
    + "SELECT source_post_id, link_url, had AS target_id FROM (SELECT source_post_id, link_url, max_by(target_post_id, pos) AS had FROM links GROUP BY 1, 2) WHERE had NOT IN (SELECT id FROM posts WHERE status IN ('publish', 'private', 'inherit'))",
    "tokenize": w(TOKENS) + "SELECT doc_id, array_to_string(tokens, ' ') AS tokens FROM tok",
    "term_frequency": w(TOKENS, WEIGHTS) + "SELECT doc_id, term, tf FROM tf",
    "document_frequency": w(TOKENS, WEIGHTS) + "SELECT term, df FROM df",
    "top_terms": w(TOKENS, WEIGHTS) + "SELECT doc_id, term, CAST(rank AS INTEGER) AS rank, round(weight, 6) AS weight FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(weight, 12) DESC, term) AS rank FROM wt) WHERE rank <= 8",
    "cosine": w(TOKENS, WEIGHTS, PAIRS)
    + """SELECT p.a, p.b, round(CASE WHEN coalesce(dot, 0) = 0 THEN 0.0::DOUBLE ELSE least(1.0::DOUBLE, dot / (x.norm * y.norm)) END, 6) AS cosine FROM pairs p
  LEFT JOIN (SELECT p.a, p.b, sum(x.weight * y.weight) AS dot FROM pairs p JOIN wt x ON x.doc_id = p.a JOIN wt y ON y.doc_id = p.b AND y.term = x.term GROUP BY 1, 2) d ON d.a = p.a AND d.b = p.b
  LEFT JOIN (SELECT doc_id, sqrt(sum(weight * weight)) AS norm FROM wt GROUP BY 1) x ON x.doc_id = p.a LEFT JOIN (SELECT doc_id, sqrt(sum(weight * weight)) AS norm FROM wt GROUP BY 1) y ON y.doc_id = p.b""",
    "batch_scores": w(TOKENS, POOLS, BATCH) + "SELECT source, target, round(cosine, 6) AS cosine FROM bs",
    "heuristic_relevance": w(DOCS, POOLS, HEUR) + "SELECT source, target, keyword, heuristic FROM heur",
    "blended_relevance": w(TOKENS, DOCS, POOLS, BATCH, HEUR)
    + "SELECT source, target, round(100.0::DOUBLE * (0.7::DOUBLE * CASE WHEN best > 0 THEN cosine / best ELSE 0.0::DOUBLE END + 0.3::DOUBLE * least(1.0::DOUBLE, heuristic / 5.0::DOUBLE)), 1) AS relevance FROM (SELECT source, target, round(cosine, 9) AS cosine, heuristic, max(round(cosine, 9)) OVER (PARTITION BY source) AS best FROM bs JOIN heur USING (source, target))",
    "target_pool": "SELECT source, target, CAST(rank AS INTEGER) AS rank FROM (SELECT s.doc_id AS source, t.doc_id AS target, row_number() OVER (PARTITION BY s.doc_id ORDER BY t.doc_id % 120, t.doc_id DESC) AS rank FROM documents s JOIN documents t ON s.doc_id <> t.doc_id AND t.doc_id <> s.doc_id + 1) WHERE rank <= 100",
    "front_runners": w(SUGGESTIONS) + "SELECT source_post_id, id, relevance_score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY source_post_id ORDER BY relevance_score DESC, id) AS rank FROM suggestions) WHERE rank <= 12",
    "keyword_match": w(DOCS, PAIRS)
    + "SELECT a, b, lower(regexp_extract(x.title, '[A-Za-z]+')) AS keyword, regexp_matches(y.text, '(?i)(^|[^\\p{L}\\p{N}\\p{M}_&])' || lower(regexp_extract(x.title, '[A-Za-z]+')) || '($|[^\\p{L}\\p{N}\\p{M}_])') AS found FROM pairs JOIN docs x ON x.doc_id = a JOIN docs y ON y.doc_id = b WHERE regexp_extract(x.title, '[A-Za-z]+') <> ''",
    "extract_links": w(HREFS) + "SELECT source_id, CAST(pos AS INTEGER) AS pos, href AS link_url, anchor AS anchor_text FROM hrefs",
    "resolve_urls": w(HREFS, RESOLVED) + "SELECT source_id, CAST(pos AS INTEGER) AS pos, url FROM res",
    "internal_links": w(HREFS, RESOLVED) + "SELECT source_id, count(*) AS internal_links FROM res WHERE regexp_replace(lower(regexp_extract(url, '://([^/?#:]*)', 1)), '^www\\.', '') = regexp_replace(lower(regexp_extract(base, '://([^/?#:]*)', 1)), '^www\\.', '') GROUP BY 1",
    "incremental_stats": w(*GRAPH) + "SELECT * FROM stats",
    "lifecycle_stats": w(*LATER) + "SELECT * FROM stats",
    "lifecycle_links": w(*LATER) + "SELECT * FROM links",
    "stored_suggestions": w(POSTS, LINKS, SUGGESTIONS)
    + """SELECT source_post_id, target_post_id, keyword, relevance_score::DOUBLE AS relevance_score, status FROM suggestions WHERE status <> 'pending' OR source_post_id NOT IN (SELECT id FROM posts WHERE id % 2 = 0)
  UNION ALL SELECT source_post_id, target_post_id, 'anew', 50.0::DOUBLE, 'pending' FROM links l WHERE pos = 1 AND source_post_id IN (SELECT id FROM posts WHERE id % 2 = 0)
  AND NOT EXISTS (SELECT 1 FROM suggestions g WHERE g.status <> 'pending' AND g.source_post_id = l.source_post_id AND g.target_post_id = l.target_post_id)""",
    "set_status": w(SUGGESTIONS)
    + """SELECT id, bool_or(there) AND max(status) = 'applied' AS succeeded FROM (SELECT a.id, a.status, a.id IN (SELECT id FROM suggestions) AS there
  FROM (SELECT id + CASE WHEN id % 2 = 0 THEN 9 ELSE 0 END AS id, CASE WHEN id % 3 = 0 THEN 'lost' ELSE 'applied' END AS status FROM suggestions WHERE id % 7 = 0) a) GROUP BY id""",
    "build_index": w(PAGES, HREFS)
    + """SELECT source_id AS source_post_id, CAST(pos AS INTEGER) AS pos, coalesce(live, hidden) AS target_post_id, href AS link_url
  FROM hrefs JOIN posts s ON s.id = source_id AND s.status = 'publish' LEFT JOIN (SELECT path, min(id) AS live FROM posts WHERE status <> 'draft' GROUP BY 1) a ON a.path = trim(href, '/')
  LEFT JOIN (SELECT path, min(id) AS hidden FROM posts WHERE status = 'draft' GROUP BY 1) b ON b.path = trim(href, '/') WHERE coalesce(live, hidden) IS NOT NULL""",
    "rerank_override": w(SUGGESTIONS)
    + "SELECT source_post_id AS source, number, coalesce(CASE WHEN source_post_id % 3 <> 2 AND number % 2 = 1 THEN least(100, (source_post_id + number) % 140)::DOUBLE END, relevance_score) AS relevance FROM (SELECT *, CAST(row_number() OVER (PARTITION BY source_post_id ORDER BY relevance_score DESC, id) AS INTEGER) AS number FROM suggestions)",
    "scorer_prompts": w(DOCS, POOLS)
    + f"""SELECT p.source, '{ASKED}' || chr(10) || 'Source: ' || any_value({_clip("s.title", 150)}) || chr(10) || any_value({_clip("s.text", 1500)}) || chr(10) || 'Targets:' || chr(10)
  || string_agg((p.target - p.source) || ') ' || ({_clip("t.title", 120)}) || ' / ' || ({_clip("t.text", 240)}) || ' / anchor: ' || ({_clip("array_to_string(list_slice(string_split(t.title, ' '), 1, 3), ' ')", 80)}), chr(10) ORDER BY p.target) AS prompt,
  CAST(count(*) AS INTEGER) AS n FROM pool p JOIN docs s ON s.doc_id = p.source JOIN docs t ON t.doc_id = p.target GROUP BY p.source""",
    "title_keywords": w(DOCS, WORDS, runs("length(core) > 2 AND lower(core) NOT IN (" + ", ".join(f"'{t}'" for t in TITLE_STOP_WORDS) + ")"))
    + """, whole AS (SELECT doc_id, any_value(head) AS keyword FROM heads JOIN cores USING (doc_id) WHERE core <> '' GROUP BY doc_id HAVING count(*) >= 3),
first_run AS (SELECT doc_id, min(run) AS run FROM (SELECT doc_id, run FROM runs GROUP BY 1, 2 HAVING count(*) >= 3) GROUP BY 1),
short AS (SELECT doc_id, array_to_string(list_slice(list(core ORDER BY i), 1, 3), ' ') AS keyword FROM runs JOIN first_run USING (doc_id, run) GROUP BY 1)
SELECT doc_id, 0 AS pos, keyword FROM whole
UNION ALL SELECT s.doc_id, CASE WHEN w.doc_id IS NULL THEN 0 ELSE 1 END, s.keyword FROM short s LEFT JOIN whole w ON w.doc_id = s.doc_id WHERE w.keyword IS NULL OR w.keyword <> s.keyword""",
    "topic_phrases": w(TOKENS, WEIGHTS, DOCS, WORDS, runs("core <> ''"))
    + f""", best AS (SELECT doc_id, term, tf, rank, length(term) >= 4 AND df <= greatest(1, ceil((SELECT count(*) FROM documents) / 2)) AS distinctive
  FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(weight, 12) DESC, term) AS rank FROM wt) WHERE rank <= 8),
grams AS (SELECT doc_id, i, core AS a, lead(core) OVER r AS b, lead(core, 2) OVER r AS c FROM runs WINDOW r AS (PARTITION BY doc_id, run ORDER BY i)),
found AS (SELECT doc_id, 1 AS kind, i, a || ' ' || b || ' ' || c AS phrase FROM grams WHERE c IS NOT NULL AND {_edge("a")} AND {_edge("c")}
  UNION ALL SELECT doc_id, 2, i, a || ' ' || b FROM grams WHERE b IS NOT NULL AND {_edge("a")} AND {_edge("b")}
  UNION ALL SELECT g.doc_id, 3, i, a FROM grams g JOIN best t ON t.doc_id = g.doc_id AND t.term = lower(a) AND distinctive WHERE {_edge("a")}
  UNION ALL SELECT doc_id, 4, rank, term FROM best WHERE distinctive AND tf >= 2)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY kind, i) - 1 AS INTEGER) AS pos, phrase FROM found""",
    "matchable_text": f"SELECT page_id, {plain('html')} AS matchable FROM pages",
    "insert_link": w(PLACES)
    + r"""SELECT page_id, keyword, CASE WHEN keyword <> '' AND regexp_matches(html, place) THEN regexp_replace(html, place, '\1<a href="https://example.test/?a=1&#038;b=2">\2</a>\3') END AS new_content FROM places""",
    "keyword_context": w(PLACES, CONTEXTS) + "SELECT page_id, keyword, trim(CASE WHEN length(body) < length(bare) THEN body || '...' ELSE body END) AS context FROM ended",
}
