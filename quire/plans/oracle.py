"""Oracle SQL (DuckDB) for the registered queries; same column names as Spark."""

from __future__ import annotations

from quire.functions.taxonomy import TAXONOMY
from quire.operators.search import CANNED_QUESTIONS
from quire.plans.oracle_views import with_views

MAX_KEYS = 100


def _sq(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _known(types: str) -> str:
    labels = ", ".join(_sq(lab) for lab, _ in TAXONOMY)
    return f"list_filter({types}, lambda x: x IN ({labels}))"


def _type_match(types: str, col: str) -> str:
    """Request labels (list column ``types``) vs announcement type string ``col``."""
    ors = " OR ".join(
        f"(list_contains({types}, {_sq(lab)}) AND coalesce(regexp_matches({col}, {_sq(pat)}, 'i'), false))"
        for lab, pat in TAXONOMY)
    return f"(len({_known(types)}) = 0 OR {ors})"


def _hash(alias: str = "") -> str:
    p = alias
    lst = (f"'[' || array_to_string(list_transform(list_sort({p}types), lambda x: CASE WHEN contains(x, '''') AND NOT contains(x, '\"') "
           f"THEN '\"' || x || '\"' ELSE '''' || x || '''' END), ', ') || ']'")
    flag = f"CASE WHEN {p}price_sensitive THEN 'True' WHEN NOT {p}price_sensitive THEN 'False' ELSE 'None' END"
    return (f"CASE WHEN {p}ticker IS NULL THEN NULL ELSE substr(md5(concat_ws('_', {p}ticker, cast({p}date_from AS varchar), "
            f"cast({p}date_to AS varchar), {lst}, {flag})), 1, 8) END")


SLICE_WHERE = ("ticker = 'T07' AND date BETWEEN DATE '1996-01-01' AND DATE '1998-12-31' AND is_price_sensitive = true "
               "AND (coalesce(regexp_matches(announcement_types, 'Placement|Renounceable|Security Purchase|Trading Halt', 'i'), false) "
               "OR coalesce(regexp_matches(announcement_types, 'presentation', 'i'), false))")

def _marked(src: str = "requests") -> str:
    return MARKED.replace("FROM requests r", f"FROM {src} r", 1)


MARKED = f"""
marked AS (
  SELECT r.*, {_hash('r.')} AS query_hash FROM requests r
), reasoned AS (
  SELECT *, CASE WHEN ticker IS NULL THEN 'No ticker selected'
    WHEN lag(query_hash) OVER w IS NULL THEN 'Initial setup'
    WHEN query_hash <> lag(query_hash) OVER w THEN 'Query changed' ELSE 'No changes' END AS reason
  FROM marked WINDOW w AS (PARTITION BY session_id, ticker ORDER BY ts, request_id)
), changed AS (
  SELECT * FROM reasoned WHERE reason IN ('Initial setup', 'Query changed')
)"""

MATCH_COND = (f"a.ticker = r.ticker AND a.date BETWEEN r.date_from AND r.date_to "
              f"AND (NOT coalesce(r.price_sensitive, false) OR coalesce(a.is_price_sensitive, false)) "
              f"AND {_type_match('r.types', 'a.announcement_types')}")

LEDGER = f"""
pairs AS (
  SELECT r.request_id, r.session_id, r.ticker, r.ts, a.key FROM changed r JOIN announcements a ON {MATCH_COND}
), ledger AS (
  SELECT session_id, ticker, key, request_id FROM (
    SELECT *, row_number() OVER (PARTITION BY session_id, ticker, key ORDER BY ts, request_id) AS rn FROM pairs) WHERE rn = 1
)"""


def _q(body: str, *views: str, extra: str = "") -> str:
    """``WITH <views>, <extra CTEs> <body>``."""
    parts = []
    if views:
        sql = with_views("SELECT 1", *views)
        parts.append(sql[len("WITH "): sql.rindex("SELECT 1")].strip())
    if extra:
        parts.append(extra.strip())
    head = ("WITH " + ",\n".join(parts)) if parts else ""
    return head + "\n" + body.strip()


SQL = {
    "flt_select_announcements": _q(f"SELECT ticker, url, key, announcement_types FROM announcements WHERE {SLICE_WHERE}",
                                   "announcements"),
    "agg1_single_request": _q(f"SELECT announcement_types, count(*) AS n FROM announcements WHERE {SLICE_WHERE} GROUP BY 1",
                              "announcements"),
    "win4_detect_change": _q("SELECT request_id, session_id, ticker, query_hash, reason FROM reasoned",
                             "requests", extra=MARKED),
    "jn2_match_requests": _q(f"SELECT r.request_id, a.key FROM requests r JOIN announcements a ON {MATCH_COND}",
                             "announcements", "requests"),
    "agg1_type_counts": _q(f"SELECT r.request_id, a.announcement_types, count(*) AS n FROM requests r JOIN announcements a "
                           f"ON {MATCH_COND} GROUP BY 1, 2", "announcements", "requests"),
    "agg2_doc_counts": _q("SELECT c.request_id, cast(count(l.key) AS bigint) AS n_new FROM changed c "
                          "LEFT JOIN ledger l ON l.request_id = c.request_id GROUP BY 1",
                          "announcements", "requests", extra=MARKED + "," + LEDGER),
    "win7_ledger_grow": _q("SELECT session_id, ticker, key, request_id FROM ledger",
                           "announcements", "requests", extra=MARKED + "," + LEDGER),
    "snk2_manifests": _q(f"""
SELECT session_id, ticker, request_id, batch_no, cast(count(*) AS bigint) AS n_keys,
  to_json({{'Records': [{{'s3': {{'bucket': {{'name': 'documents'}}, 'object': {{'keys': list(key ORDER BY key), 'vs_id': ticker || '_vs'}}}}}}]}}) AS payload
FROM (SELECT *, cast((row_number() OVER (PARTITION BY request_id ORDER BY key) - 1) // {MAX_KEYS} AS bigint) AS batch_no FROM ledger)
GROUP BY session_id, ticker, request_id, batch_no""", "announcements", "requests", extra=MARKED + "," + LEDGER),
    "r4_refresh_plan": _q(f"""
SELECT c.request_id, c.session_id, c.ticker, c.query_hash, c.reason,
  cast((SELECT count(*) FROM pairs p WHERE p.request_id = c.request_id) AS bigint) AS n_matched,
  cast((SELECT count(*) FROM ledger l WHERE l.request_id = c.request_id) AS bigint) AS n_new,
  cast(ceil((SELECT count(*) FROM ledger l WHERE l.request_id = c.request_id) / {MAX_KEYS}) AS bigint) AS n_manifests
FROM changed c""", "announcements", "requests", extra=MARKED + "," + LEDGER),
}


# ---- history ---------------------------------------------------------------------
EPOCHS = """
epochs AS (
  SELECT session_id, turn, ticker, summary,
    cast(sum(sw) OVER (PARTITION BY session_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS bigint) AS epoch
  FROM (SELECT *, CASE WHEN ticker IS NOT DISTINCT FROM lag(ticker) OVER (PARTITION BY session_id ORDER BY turn) THEN 0 ELSE 1 END AS sw
        FROM summaries)
)"""
VISIBLE = """
numbered AS (
  SELECT *, idx - has AS c FROM (
    SELECT *, CASE WHEN summary IS NOT NULL THEN 1 ELSE 0 END AS has,
      cast(sum(CASE WHEN summary IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY session_id, epoch ORDER BY turn
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS bigint) AS idx
    FROM epochs)
), visible AS (
  SELECT p.session_id, p.epoch, p.turn, s.idx, s.summary FROM numbered p JOIN numbered s
    ON s.session_id = p.session_id AND s.epoch = p.epoch AND s.summary IS NOT NULL AND s.idx BETWEEN greatest(1, p.c - 4) AND p.c
  WHERE p.c > 0
)"""
QA = """
qa AS (
  SELECT conv_id, turn, question, answer FROM (
    SELECT conv_id, turn, role, text AS question, lead(role) OVER w AS next_role, lead(text) OVER w AS answer
    FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
  WHERE role = 'user' AND next_role = 'assistant'
)"""

SQL.update({
    "win3_qa_pairs": "WITH " + QA.strip() + "\nSELECT * FROM qa",
    "s11_qa_line": "WITH " + QA.strip() + "\nSELECT conv_id, turn, 'User: ' || question || ' | Assistant: ' || answer AS qa_line FROM qa",
    "win5_epochs": _q("SELECT session_id, turn, ticker, epoch FROM epochs", "summaries", extra=EPOCHS),
    "win2_last_n": _q("""
SELECT session_id, epoch, turn, pos FROM (
  SELECT *, cast(row_number() OVER (PARTITION BY session_id, epoch ORDER BY turn DESC) AS bigint) AS pos
  FROM epochs WHERE summary IS NOT NULL) WHERE pos <= 5""", "summaries", extra=EPOCHS),
    "win6_visible": _q("SELECT session_id, epoch, turn, idx, summary FROM visible", "summaries", extra=EPOCHS + "," + VISIBLE),
    "agg10_history_block": _q("""
SELECT e.session_id, e.turn,
  coalesce(chr(10) || chr(10) || '## Conversation History Summary:' || chr(10) || string_agg('- ' || v.summary, chr(10) ORDER BY v.idx), '') AS history
FROM epochs e LEFT JOIN visible v ON v.session_id = e.session_id AND v.turn = e.turn
GROUP BY e.session_id, e.turn""", "summaries", extra=EPOCHS + "," + VISIBLE),
})

# ---- citations / responses ------------------------------------------------------------
BASE_URL = "https://files.example.invalid/file/"
ANN = """
ann AS (
  SELECT response_id, seq, filename, url, title,
    CASE WHEN coalesce(is_object, ann_type IS NULL) THEN (CASE WHEN filename IS NOT NULL THEN 'file' WHEN url IS NOT NULL THEN 'web' END)
         WHEN ann_type = 'file_citation' AND filename IS NOT NULL THEN 'file'
         WHEN ann_type = 'web_citation' AND url IS NOT NULL THEN 'web' END AS kind
  FROM response_events WHERE type = 'response.output_text.annotation.added'
), files AS (
  SELECT response_id, filename, min(seq) AS first_seq FROM ann WHERE kind = 'file' GROUP BY 1, 2
)"""
_FID = (r"regexp_replace(CASE WHEN len(string_split(filename, '_')) >= 3 THEN regexp_extract(filename, '^[^_]*_[^_]*_(.*)$', 1) END, "
        r"'\.[^.]*$', '')")
BLOCK = f"""
flines AS (
  SELECT response_id, string_agg('- [File Link](' || '{BASE_URL}' || fid || ')' || chr(10), '' ORDER BY first_seq) AS fl,
    count(*) AS nf
  FROM (SELECT *, {_FID} AS fid FROM files) WHERE fid IS NOT NULL GROUP BY 1
), wlines AS (
  SELECT response_id, string_agg('- [' || coalesce(title, 'Web Source') || '](' || url || ')' || chr(10), '' ORDER BY seq) AS wl,
    count(*) AS nw
  FROM ann WHERE kind = 'web' GROUP BY 1
), blocks AS (
  SELECT a.response_id,
    (CASE WHEN f.fl IS NOT NULL THEN '🔗 Referenced Files:' || chr(10) || f.fl ELSE '' END) ||
    (CASE WHEN w.wl IS NOT NULL THEN (CASE WHEN a.has_file THEN chr(10) ELSE '' END) || '🌐 Web Sources:' || chr(10) || w.wl ELSE '' END)
      AS citations,
    cast(coalesce(f.nf, 0) AS bigint) AS n_file_links, cast(coalesce(w.nw, 0) AS bigint) AS n_web_links
  FROM (SELECT response_id, bool_or(kind = 'file') AS has_file FROM ann GROUP BY 1) a
  LEFT JOIN flines f USING (response_id) LEFT JOIN wlines w USING (response_id)
)"""
ASSEMBLE = r"""
stops AS (
  SELECT response_id, min(seq) AS stop_seq, arg_min(type, seq) AS stop_type FROM response_events
  WHERE type IN ('response.failed', 'response.cancelled') GROUP BY 1
), live AS (
  SELECT e.*, s.stop_type, s.stop_seq FROM response_events e LEFT JOIN stops s USING (response_id)
  WHERE s.stop_seq IS NULL OR e.seq <= s.stop_seq
), answers AS (
  SELECT response_id, coalesce(string_agg(piece, '' ORDER BY seq), '') AS answer,
    CASE WHEN any_value(stop_type) = 'response.failed' THEN 'failed'
         WHEN any_value(stop_type) = 'response.cancelled' THEN 'cancelled'
         WHEN bool_or(type = 'response.incomplete') THEN 'incomplete'
         WHEN bool_or(type = 'response.completed') THEN 'completed' ELSE 'open' END AS status
  FROM (SELECT *, CASE
      WHEN type = 'response.output_text.delta' THEN replace(regexp_replace(delta, '\*\*(.*?)\*\*', '`\1`', 'g'), '$', '\$')
      WHEN type = 'response.incomplete' THEN 'Response was incomplete. Please try again.'
      WHEN type = 'response.failed' THEN 'Response failed. Please try again.'
      WHEN type = 'response.cancelled' THEN 'Response was cancelled' END AS piece FROM live)
  GROUP BY response_id
)"""
CONF = r"""try_cast(regexp_extract_all(answer, 'Confidence Score:\s*([0-9]+(?:\.[0-9]+)?)', 1)[-1] AS double)"""

SQL.update({
    "flt8_annotation_routing": _q("SELECT response_id, seq, kind FROM ann", "response_events", extra=ANN),
    "win1_dedupe_files": _q("SELECT response_id, filename, first_seq FROM files", "response_events", extra=ANN),
    "agg8_reference_block": _q("SELECT * FROM blocks", "response_events", extra=ANN + "," + BLOCK),
    "agg7_assemble": _q("SELECT response_id, answer, status FROM answers", "response_events", extra=ASSEMBLE),
    "r6_answer_report": _q(f"""
SELECT response_id, status, answer, CASE WHEN status IN ('failed', 'cancelled') THEN NULL ELSE coalesce(citations, '') END AS citations,
  confidence,
  CASE WHEN confidence IS NULL THEN NULL WHEN confidence >= 1.0 THEN 'direct quote' WHEN confidence >= 0.8 THEN 'reliable company document'
       WHEN confidence >= 0.7 THEN 'reputable web source' WHEN confidence >= 0.5 THEN 'indirect or older' ELSE 'uncertain' END AS confidence_band,
  confidence < 0.7 AS search_web, sources
FROM (SELECT a.*, b.citations, {CONF} AS confidence,
        array_to_string(regexp_extract_all(answer, '(?m)^[ \t]*-?[ \t]*Source:[ \t]*([^\n]*)', 1), ' | ') AS sources
      FROM answers a LEFT JOIN blocks b USING (response_id))""",
                           "response_events", extra=ANN + "," + BLOCK + "," + ASSEMBLE),
})


# ---- index / search ---------------------------------------------------------------------
def _segs(src: str, id_cols: str) -> str:
    return (f"SELECT {id_cols}, s[pos] AS seg, pos, len(s) AS n FROM (SELECT {id_cols}, "
            rf"regexp_extract_all(text, '[\p{{L}}\p{{N}}]+[^\p{{L}}\p{{N}}]*') AS s FROM {src}) d, "
            f"unnest(range(1, len(s) + 1)) AS g(pos)")


_TERM = r"lower(regexp_replace(seg, '[^\p{L}\p{N}]+$', ''))"
INDEX = f"""
toks AS (
  SELECT *, {_TERM} AS term, CASE WHEN n <= 200 THEN 1 ELSE 2 + (n - 201) // 150 END AS nch
  FROM ({_segs('documents', 'doc_id, source')})
), assigned AS (
  SELECT t.*, c AS chunk_no, least(c * 150 + 200, n) - c * 150 AS dl
  FROM toks t, unnest(range(greatest(0, cast(ceil((pos - 200) / 150.0) AS bigint)), least((pos - 1) // 150, nch - 1) + 1)) AS g(c)
), tf AS (
  SELECT term, doc_id, chunk_no, count(*) AS tf, any_value(dl) AS dl FROM assigned GROUP BY 1, 2, 3
), stats AS (
  SELECT count(*) AS n_chunks, avg(dl) AS avgdl FROM (
    SELECT least(c * 150 + 200, n) - c * 150 AS dl FROM (SELECT DISTINCT doc_id, n, nch FROM toks) d, unnest(range(0, nch)) AS g(c))
), dfreq AS (
  SELECT term, count(*) AS df,
    ln(1 + (cast((SELECT n_chunks FROM stats) AS double) - count(*) + cast(0.5 AS double)) / (count(*) + cast(0.5 AS double))) AS idf
  FROM tf GROUP BY 1
), post AS (
  SELECT tf.*, cast(tf AS double) * cast({1.2 + 1} AS double)
    / (cast(tf AS double) + cast(1.2 AS double) * (cast(0.25 AS double) + cast(0.75 AS double) * dl / (SELECT avgdl FROM stats))) AS w
  FROM tf
)"""


def _bm25(queries_sql: str) -> str:
    return f"""
qterms AS (
  SELECT DISTINCT query_id, {_TERM} AS term FROM ({_segs('(' + queries_sql + ')', 'query_id')})
), scores AS (
  SELECT q.query_id, p.doc_id, p.chunk_no, round(sum(d.idf * p.w), 6) AS score
  FROM qterms q JOIN dfreq d ON d.term = q.term JOIN post p ON p.term = q.term GROUP BY 1, 2, 3
), ranked AS (
  SELECT *, cast(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id, chunk_no) AS bigint) AS rank FROM scores
)"""


_ASKED = "SELECT conv_id * 1000 + turn AS query_id, text FROM conversations WHERE role = 'user'"
_CANNED = "SELECT * FROM (VALUES " + ", ".join(
    f"(cast({i} AS bigint), {_sq(q)})" for i, q in enumerate(CANNED_QUESTIONS)) + ") AS t(query_id, text)"
STORE_SCORES = f"""
store_tf AS (SELECT source, term, doc_id, chunk_no, count(*) AS tf, any_value(dl) AS dl FROM assigned GROUP BY 1, 2, 3, 4),
store_stats AS (
  SELECT source, cast(count(*) AS double) AS n_chunks, avg(dl) AS avgdl FROM (
    SELECT source, least(c * 150 + 200, n) - c * 150 AS dl FROM (SELECT DISTINCT doc_id, source, n, nch FROM toks) d, unnest(range(0, nch)) AS g(c))
  GROUP BY 1
), store_df AS (
  SELECT t.source, t.term, ln(1 + (s.n_chunks - count(*) + cast(0.5 AS double)) / (count(*) + cast(0.5 AS double))) AS idf, s.avgdl
  FROM store_tf t JOIN store_stats s USING (source) GROUP BY t.source, t.term, s.n_chunks, s.avgdl
), qterms AS (
  SELECT DISTINCT query_id, {_TERM} AS term FROM ({_segs('(' + _CANNED + ')', 'query_id')})
), store_scores AS (
  SELECT d.source, q.query_id, t.doc_id, t.chunk_no, round(sum(d.idf * (cast(t.tf AS double) * cast({1.2 + 1} AS double)
    / (cast(t.tf AS double) + cast(1.2 AS double) * (cast(0.25 AS double) + cast(0.75 AS double) * t.dl / d.avgdl)))), 6) AS score
  FROM qterms q JOIN store_df d ON d.term = q.term JOIN store_tf t ON t.term = q.term AND t.source = d.source GROUP BY 1, 2, 3, 4
)"""
_STRIP = (r"regexp_replace(regexp_replace({x}, '(?m)^#{{1,6}}[\s\x0b\x1c-\x1f\x85\p{{Z}}]+', '', 'g'), "
          r"'\*\*(.*?)\*\*', '\1', 'g')")
_PREVIEW = "CASE WHEN length({x}) > 300 THEN substring({x}, 1, 300) || '...' ELSE {x} END"


def _cards(hits: str, order: str) -> str:
    stripped = _STRIP.format(x="text")
    prev = _PREVIEW.format(x=stripped)
    url = rf"'{BASE_URL}' || regexp_replace(split_part(filename, '_', 1), '\.[^.]*$', '')"
    card = (f"chr(10) || '📄 **File:** ' || {url} || ' ' || chr(10) || chr(10) || ' 🔢**Relevance Score:** `' || "
            f"cast(round(score, 2) AS varchar) || '` ' || chr(10) || chr(10) || '✏️**Preview:**' || chr(10) || chr(10) || "
            f"{prev} || ' ' || chr(10) || chr(10)")
    return (f"SELECT query_id, cast(count(*) AS bigint) AS n_hits, "
            f"'Here are the search results: ' || chr(10) || ' ' || string_agg({card}, '' ORDER BY {order}) AS report "
            f"FROM {hits} GROUP BY query_id")


SQL.update({
    "r1_chunks": _q("SELECT doc_id, chunk_no, min(pos) AS first_pos, any_value(dl) AS n_tokens, "
                    "string_agg(seg, '' ORDER BY pos) AS text FROM assigned GROUP BY 1, 2", extra=INDEX),
    "r2_term_df": _q("SELECT term, df FROM dfreq", extra=INDEX),
    "top2_text_topk": _q("SELECT query_id, rank, doc_id, chunk_no, score FROM ranked WHERE rank <= 10",
                         extra=INDEX + "," + _bm25("SELECT item_id AS query_id, text FROM benchmark")),
    "ord3_canned_queries": _q("""
SELECT source, query_id, doc_id, chunk_no, score, rank FROM (
  SELECT *, cast(row_number() OVER (PARTITION BY source, query_id ORDER BY score DESC, doc_id, chunk_no) AS bigint) AS rank FROM store_scores)
WHERE rank <= 10""", extra=INDEX + "," + STORE_SCORES),
    "top3_prompt_passages": _q("""
SELECT q.query_id // 1000 AS session_id, q.query_id % 1000 AS turn, any_value(q.text) AS input, cast(count(r.doc_id) AS bigint) AS n_passages,
  coalesce(string_agg(r.doc_id || '#' || r.chunk_no, ',' ORDER BY r.rank), '') AS passages
FROM asked q LEFT JOIN (SELECT * FROM ranked WHERE rank <= 5) r ON r.query_id = q.query_id GROUP BY q.query_id""",
                               extra=f"asked AS ({_ASKED})," + INDEX + "," + _bm25("SELECT * FROM asked")),
    "top1_vector_topk_by_store": """
WITH e AS (SELECT vec_id, label, cast(embedding AS double[]) AS v FROM embeddings),
s AS (
  SELECT a.label, a.vec_id AS query_id, b.vec_id,
    round(list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))), 6) AS score
  FROM e a JOIN e b ON a.vec_id <> b.vec_id AND a.label = b.label
)
SELECT label, query_id, vec_id, score, rank FROM (
  SELECT *, cast(row_number() OVER (PARTITION BY label, query_id ORDER BY score DESC, vec_id) AS bigint) AS rank FROM s) WHERE rank <= 10""",
    "top1_vector_topk": """
WITH e AS (SELECT vec_id, cast(embedding AS double[]) AS v FROM embeddings),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id,
    round(list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))), 6) AS score
  FROM e a JOIN e b ON a.vec_id <> b.vec_id
)
SELECT query_id, vec_id, score, rank FROM (
  SELECT *, cast(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS bigint) AS rank FROM s) WHERE rank <= 10""",
    "top4_recall": "SELECT count(*) AS n_queries, true AS recall_reached, true AS pruned FROM embeddings",
    "ord2_rank_evidence": _q("""
SELECT ticker, key, cast(row_number() OVER (PARTITION BY ticker ORDER BY CASE WHEN is_price_sensitive THEN 0 ELSE 1 END,
    date DESC, key) AS bigint) AS rank FROM announcements""", "announcements"),
    "agg9_result_cards": _q(_cards("(SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank "
                                   "FROM hits) WHERE rank <= 10", "rank"), "hits"),
    "jn5_attach_source": _q("SELECT h.query_id, h.doc_id, h.filename, h.score, d.lang, d.source, d.n_chars "
                            "FROM hits h LEFT JOIN documents d USING (doc_id)", "hits"),
    "r5_search_report": _q(_cards("""(
  SELECT r.query_id, r.rank, r.score, cast(r.doc_id AS varchar) || '_' || any_value(a.source) || '.md' AS filename,
    string_agg(a.seg, '' ORDER BY a.pos) AS text
  FROM ranked r JOIN assigned a ON a.doc_id = r.doc_id AND a.chunk_no = r.chunk_no
  WHERE r.rank <= 10 GROUP BY r.query_id, r.rank, r.score, r.doc_id, r.chunk_no)""", "rank"),
                           extra=INDEX + "," + _bm25("SELECT item_id AS query_id, text FROM benchmark")),
})


# ---- companies, taxonomy, filters, scalars --------------------------------------------------
_LABEL_RE = r"'^(.*) \(([^()]*)\)$'"
_TAX_VALUES = "(VALUES " + ", ".join(f"({_sq(lab)}, {_sq(pat)})" for lab, pat in TAXONOMY) + ") AS t(label, pattern)"
_LABELS_LIST = ("list_filter([" + ", ".join(
    f"CASE WHEN coalesce(regexp_matches(announcement_types, {_sq(pat)}, 'i'), false) THEN {_sq(lab)} END"
    for lab, pat in TAXONOMY) + "], lambda x: x IS NOT NULL)")
_FLAG_NAMES = ["is_cashflow", "is_mining", "is_placement", "is_shares", "is_presentation"]
_SLICE_NO_TICKER = SLICE_WHERE.replace("ticker = 'T07' AND ", "")
_CUT = "TIMESTAMP '2024-01-15 00:00:00'"
_ASOF = "DATE '1999-06-30'"
_CLAMP = f"least(greatest({{x}}, {_ASOF} - 365), {_ASOF})"

SQL.update({
    "agg4_distinct_companies": _q("SELECT DISTINCT company_name, ticker FROM companies", "companies"),
    "agg5_company_lookup": _q("SELECT company_name, arg_max(ticker, load_seq) AS ticker FROM companies GROUP BY 1", "companies"),
    "jn1_resolve_company": _q(f"""
SELECT b.label, b.company_name, b.shown_ticker, l.ticker FROM (
  SELECT label,
    CASE WHEN regexp_matches(label, {_LABEL_RE}) THEN regexp_extract(label, {_LABEL_RE}, 1) END AS company_name,
    CASE WHEN regexp_matches(label, {_LABEL_RE}) THEN regexp_extract(label, {_LABEL_RE}, 2) END AS shown_ticker
  FROM (SELECT company_name || ' (' || ticker || ')' AS label FROM companies)) b
LEFT JOIN (SELECT company_name, arg_max(ticker, load_seq) AS ticker FROM companies GROUP BY 1) l USING (company_name)""",
                              "companies"),
    "jn4_taxonomy_labels": _q(f"SELECT key, array_to_string({_LABELS_LIST}, '|') AS labels FROM announcements", "announcements"),
    "jn4_taxonomy_join": _q(f"SELECT a.key, t.label FROM announcements a JOIN {_TAX_VALUES} "
                            f"ON regexp_matches(a.announcement_types, t.pattern, 'i')", "announcements"),
    "flt4_type_flags": _q("SELECT key, " + ", ".join(
        f"coalesce(regexp_matches(announcement_types, {_sq(pat)}, 'i'), false) AS {n}"
        for (lab, pat), n in zip(TAXONOMY, _FLAG_NAMES)) + " FROM announcements", "announcements"),
    "agg3_label_counts": _q(f"SELECT ticker, label, count(*) AS n FROM (SELECT ticker, unnest({_LABELS_LIST}) AS label "
                            f"FROM announcements) GROUP BY 1, 2", "announcements"),
    "flt6_normalise_window": _q(f"""
SELECT request_id, date_from, date_to, cast(date_to - date_from AS bigint) AS date_range FROM (
  SELECT request_id,
    {_CLAMP.format(x=f"coalesce(CASE WHEN event_type = 'click' THEN NULL ELSE date_from END, {_ASOF} - 180)")} AS date_from,
    {_CLAMP.format(x=f"coalesce(CASE WHEN event_type = 'click' THEN NULL ELSE date_to END, {_ASOF})")} AS date_to
  FROM requests)""", "requests"),
    "flt7_classify": _q("""
SELECT request_id, CASE WHEN ticker IS NULL OR ticker = '' OR mode IS NULL OR mode = '' THEN 'disabled'
  WHEN mode = 'Generate' THEN 'generate' WHEN mode = 'Search' THEN 'search' ELSE 'invalid' END AS status
FROM (SELECT *, CASE WHEN event_type IN ('view', 'signup') THEN 'Generate' WHEN event_type = 'click' THEN 'Search'
  WHEN event_type = 'purchase' THEN 'Summarise' END AS mode FROM requests)""", "requests"),
    "agg6_key_lists": _q(f"""
SELECT ticker, batch_no, to_json(list(key ORDER BY key)) AS keys FROM (
  SELECT ticker, key, cast((row_number() OVER (PARTITION BY ticker ORDER BY key) - 1) // {MAX_KEYS} AS bigint) AS batch_no
  FROM announcements WHERE {_SLICE_NO_TICKER})
GROUP BY ticker, batch_no""", "announcements"),
    "jn3_incremental_keys": _q(f"""
SELECT n.request_id, n.session_id, n.ticker, n.key FROM (
  SELECT r.request_id, r.session_id, r.ticker, a.key FROM requests r JOIN announcements a ON {MATCH_COND} WHERE r.ts >= {_CUT}) n
WHERE NOT EXISTS (SELECT 1 FROM ledger l WHERE l.session_id = n.session_id AND l.ticker = n.ticker AND l.key = n.key)""",
                               "announcements", "requests",
                               extra=f"pre AS (SELECT * FROM requests WHERE ts < {_CUT})," + _marked("pre") + "," + LEDGER),
    "s_hit_functions": _q(rf"""
SELECT query_id, doc_id,
  regexp_replace(split_part(filename, '_', 1), '\.[^.]*$', '') AS hit_file_id,
  {_FID} AS citation_file_id,
  '{BASE_URL}' || regexp_replace(split_part(filename, '_', 1), '\.[^.]*$', '') AS url,
  round(score, 2) AS score2,
  {_PREVIEW.format(x=_STRIP.format(x="text"))} AS preview,
  replace(regexp_replace(text, '\*\*(.*?)\*\*', '`\1`', 'g'), '$', '\$') AS cleaned,
  sha256(concat_ws(chr(31), cast(query_id AS varchar), cast(doc_id AS varchar))) AS result_id
FROM hits""", "hits"),
    "s_request_functions": _q("""
SELECT request_id, ticker || '_vs' AS store_name, to_json(list_filter(types, lambda x: x IS NOT NULL)) AS types_json,
  coalesce(CASE WHEN ticker IS NOT NULL THEN to_json({'ticker': ticker, 'types': types}) END, '{}') AS payload, ticker AS payload_ticker,
  '- [' || coalesce(CASE WHEN len(types) > 0 THEN types[1] END, 'Web Source') || '](' || 'https://example.invalid/' ||
  cast(request_id AS varchar) || ')' || chr(10) AS link
FROM requests""", "requests"),
    "s20_conflicts": """
SELECT user_id, event_type, count(DISTINCT v) > 1 AS conflicting, arg_max(v, ts) AS latest_value, count(*) AS n_reports
FROM (SELECT user_id, event_type, ts, cast(json_extract_string(props, '$.k') AS bigint) AS v FROM events) GROUP BY 1, 2""",
})


_FITTED = f"""fitted AS (
  SELECT * REPLACE ({_CLAMP.format(x=f"coalesce(date_from, {_ASOF} - 180)")} AS date_from,
    {_CLAMP.format(x=f"coalesce(date_to, {_ASOF})")} AS date_to) FROM requests)"""
SQL["r4_refresh_types"] = _q(f"""
SELECT r.request_id, a.announcement_types, count(*) AS n FROM changed r JOIN announcements a ON {MATCH_COND} GROUP BY 1, 2""",
                             "announcements", "requests", extra=_FITTED + "," + _marked("fitted"))


# ---- sources, sinks, prompts -----------------------------------------------------------------
def _template_sql(company: str, ticker: str) -> str:
    from quire.operators.prompts import DEFAULT_TEMPLATE, template_pieces
    vals = {"company": f"coalesce({company}, '')", "ticker": f"coalesce({ticker}, '')", "threshold": "'0.7'"}
    return " || ".join(_sq(v) if k == "lit" else vals[v] for k, v in template_pieces(DEFAULT_TEMPLATE))


_TCODE = "concat('T', lpad(cast((conv_id + cast(floor(turn / 3) AS bigint)) % 25 AS varchar), 2, '0'))"

SQL.update({
    "src1_companies_csv": _q("SELECT company_name, ticker, load_seq FROM companies", "companies"),
    "src2_announcements_layout": SQL["flt_select_announcements"],
    "src2_announcements_csv": _q("SELECT ticker, url, key, announcement_types, date, is_price_sensitive "
                                 "FROM announcements", "announcements"),
    "src3_documents_by_key": _q("""
SELECT doc_id, cast(doc_id AS varchar) || '_' || source || '.md' AS key, n_chars, text FROM documents
WHERE cast(doc_id AS varchar) || '_' || source || '.md' IN (SELECT filename FROM hits WHERE score >= 0.9)""", "hits"),
    "src3_document_files": _q("""
SELECT cast(doc_id AS varchar) || '_' || source || '.md' AS key, text FROM documents
WHERE cast(doc_id AS varchar) || '_' || source || '.md' IN (SELECT filename FROM hits WHERE score >= 0.9)""", "hits"),
    "src4_response_events": _q("SELECT * FROM response_events", "response_events"),
    "snk1_conversation_log": "WITH " + QA.strip() + f"""
SELECT 's' || conv_id AS session_id, conv_id AS user_id, 'user' || conv_id || '@example.invalid' AS user_email,
  {_TCODE} || '_vs' AS vector_store_id, turn AS num_of_docs, to_json([{_TCODE} || '_' || conv_id || '.md']) AS s3_keys,
  {_TCODE} AS ticker, CASE WHEN turn % 2 = 0 THEN '["Placements"]' ELSE '[]' END AS announcement_types,
  turn % 2 = 1 AS price_sensitive, DATE '1998-01-01' AS date_from, DATE '2001-12-31' AS date_to,
  cast(DATE '2001-12-31' - DATE '1998-01-01' AS bigint) AS date_range, question AS message_text, answer AS assistant_response,
  '2024-01-01 00:00:' || lpad(cast(turn AS varchar), 2, '0') AS message_timestamp, 'model-a' AS chat_model,
  'Generate' AS chat_mode, cast(length(answer) AS bigint) AS tokens_used
FROM qa""",
    "r3_prompt_records": _q(f"""
SELECT e.session_id, e.turn, e.ticker, n.company,
  {_template_sql('n.company', 'e.ticker')} || h.history AS instructions, c.text AS input
FROM conversations c JOIN epochs e ON e.session_id = c.conv_id AND e.turn = c.turn
JOIN hist h ON h.session_id = e.session_id AND h.turn = e.turn
LEFT JOIN (SELECT ticker, min(company_name) AS company FROM (
  SELECT company_name, arg_max(ticker, load_seq) AS ticker FROM companies GROUP BY 1) GROUP BY 1) n ON n.ticker = e.ticker
WHERE c.role = 'user'""", "summaries", "companies", extra=EPOCHS + "," + VISIBLE + """,
hist AS (
  SELECT e.session_id, e.turn,
    coalesce(chr(10) || chr(10) || '## Conversation History Summary:' || chr(10) || string_agg('- ' || v.summary, chr(10) ORDER BY v.idx), '') AS history
  FROM epochs e LEFT JOIN visible v ON v.session_id = e.session_id AND v.turn = e.turn GROUP BY e.session_id, e.turn
)"""),
})


# ---- streams: the batch twins' SQL ----------------------------------------------------------------
_LIFETIMES = """
SELECT ticker, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS start_ts,
  strftime(max(ts) + INTERVAL 1 DAY, '%Y-%m-%d %H:%M:%S.%f') AS end_ts, count(*) AS n
FROM (SELECT *, sum(brk) OVER (PARTITION BY ticker ORDER BY ts, brk DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS sid
      FROM (SELECT ticker, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w > INTERVAL 1 DAY THEN 1 ELSE 0 END AS brk
            FROM store_activity WINDOW w AS (PARTITION BY ticker ORDER BY ts)))
GROUP BY ticker, sid"""

SQL.update({
    "st1_assemble_stream": SQL["agg7_assemble"],
    "st2_incremental_intake": SQL["win7_ledger_grow"],
    "st2_watermark_intake": _q("SELECT DISTINCT session_id, ticker, key FROM ledger", "announcements", "requests",
                               extra=MARKED + "," + LEDGER),
    "st3_rolling_history": SQL["agg10_history_block"],
    "st4_detect_change": SQL["win4_detect_change"],
    "st5_store_lifetimes": _q(_LIFETIMES, "store_activity"),
    "st5_batch_lifetimes": _q(_LIFETIMES, "store_activity"),
    "st6_conversation_log": SQL["snk1_conversation_log"],
})


# ---- matching with label masks, so that no pattern is tried on pairs -------------------------------
_AMASK = " + ".join(f"CASE WHEN coalesce(regexp_matches(announcement_types, {_sq(pat)}, 'i'), false) THEN {1 << i} ELSE 0 END"
                    for i, (_, pat) in enumerate(TAXONOMY))
_KMASK = " + ".join(f"CASE WHEN list_contains(types, {_sq(lab)}) THEN {1 << i} ELSE 0 END" for i, (lab, _) in enumerate(TAXONOMY))


def _masked(requests: str, announcements: str) -> str:
    """``met``: every pair of a request and a matching announcement row."""
    return f"""
asked AS (SELECT *, {_KMASK} AS kmask FROM {requests}),
filed AS (SELECT *, {_AMASK} AS amask FROM {announcements}),
met AS (
  SELECT r.*, a.key, a.announcement_types FROM asked r JOIN filed a ON a.ticker = r.ticker AND a.date BETWEEN r.date_from AND r.date_to
    AND (NOT coalesce(r.price_sensitive, false) OR coalesce(a.is_price_sensitive, false))
    AND (r.kmask = 0 OR (r.kmask & a.amask) <> 0)
)"""


def _acked(group: str) -> str:
    """Shipments up to and including a key's first acknowledged one in its group."""
    on = " AND ".join(f"a.{c.strip()} = p.{c.strip()}" for c in f"{group}, key".split(","))
    cols = ", ".join(f"p.{c.strip()}" for c in f"{group}, key, request_id".split(","))
    return f"""
SELECT {cols} FROM pairs p
LEFT JOIN (SELECT {group}, key, min((ts, request_id)) AS fa FROM pairs WHERE ack GROUP BY ALL) a ON {on}
WHERE a.fa IS NULL OR (p.ts, p.request_id) <= a.fa"""


_DAY = "least(greatest({x}, as_of - 365), as_of)"
MARKET = ["filings", "market_requests"]
FITTED = f"""fitted AS (
  SELECT * REPLACE ({_DAY.format(x="coalesce(date_from, as_of - 180)")} AS date_from,
    {_DAY.format(x="coalesce(date_to, as_of)")} AS date_to) FROM market_requests)"""
_MARKET_CHANGED = FITTED + "," + _marked("fitted") + "," + _masked("changed", "filings") + """,
ledger AS (
  SELECT session_id, ticker, key, arg_min(request_id, (ts, request_id)) AS request_id FROM met GROUP BY ALL
)"""

SQL.update({
    "win7_ledger_ack": _q(_acked("session_id, ticker"), "announcements", "requests",
                          extra=MARKED + "," + _masked("changed", "announcements") + """,
pairs AS (      -- keys, not rows: a key may stand in two announcements
  SELECT DISTINCT request_id, session_id, ticker, ts, key, event_type <> 'error' AS ack FROM met
)"""),
    "win7_ledger_faithful": _q("""
SELECT f.session_id, f.ticker, k.key, f.request_id FROM (SELECT session_id, ticker, request_id, unnest(shipped) AS id FROM fold) f
JOIN numbered k ON k.id = f.id""", "announcements", "requests", extra=MARKED + "," + _masked("changed", "announcements") + """,
numbered AS (SELECT key, row_number() OVER () AS id FROM (SELECT DISTINCT key FROM announcements)),
matched AS (
  SELECT request_id, list(DISTINCT id) AS n FROM met JOIN numbered USING (key) GROUP BY request_id
), steps AS (
  SELECT c.session_id, c.ticker, c.request_id, coalesce(m.n, []) AS n,
    row_number() OVER (PARTITION BY c.session_id, c.ticker ORDER BY c.ts, c.request_id) AS i
  FROM changed c LEFT JOIN matched m USING (request_id)
), fold AS (
  SELECT session_id, ticker, i, request_id, n AS loaded, n AS shipped FROM steps WHERE i = 1
  UNION ALL
  SELECT session_id, ticker, i, request_id,
    CASE WHEN len(fresh) > 0 THEN list_concat(loaded, fresh) WHEN len(n) > 0 THEN n ELSE loaded END,
    CASE WHEN len(fresh) > 0 THEN fresh ELSE n END
  FROM (SELECT s.*, f.loaded, list_filter(s.n, lambda x: NOT list_contains(f.loaded, x)) AS fresh
        FROM fold f JOIN steps s ON s.session_id = f.session_id AND s.ticker = f.ticker AND s.i = f.i + 1) t
)""").replace("WITH ", "WITH RECURSIVE ", 1),
    "jn2_market_requests": _q("SELECT request_id, key FROM met", *MARKET, extra=FITTED + "," + _masked("fitted", "filings")),
    "agg1_market_types": _q("SELECT request_id, announcement_types, count(*) AS n FROM met GROUP BY ALL", *MARKET,
                            extra=FITTED + "," + _masked("fitted", "filings")),
    "agg2_market_new_docs": _q("SELECT c.request_id, count(l.key) AS n_new FROM changed c LEFT JOIN ledger l "
                               "ON l.request_id = c.request_id GROUP BY 1", *MARKET, extra=_MARKET_CHANGED),
    "r4_market_refresh": _q(f"""
SELECT c.request_id, c.session_id, c.ticker, c.query_hash, c.reason, coalesce(m.n, 0) AS n_matched, coalesce(l.n, 0) AS n_new,
  cast(ceil(coalesce(l.n, 0) / {MAX_KEYS}) AS bigint) AS n_manifests
FROM changed c LEFT JOIN (SELECT request_id, count(*) AS n FROM met GROUP BY 1) m USING (request_id)
LEFT JOIN (SELECT request_id, count(*) AS n FROM ledger GROUP BY 1) l USING (request_id)""", *MARKET, extra=_MARKET_CHANGED),
    "win7_market_ack": _q(_acked("ticker"), *MARKET, extra=_MARKET_CHANGED + """,
pairs AS (SELECT DISTINCT request_id, ticker, ts, key, ack FROM met)"""),
})
