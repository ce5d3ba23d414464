"""The operators as named queries over the whole test tables, with SQL where SQL can state the result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colonnade.llm import (
    attention, conversations, decontaminate, lexical_search, line_dedup, near_dedup, packing, quality_rules, secrets,
    substring_dedup, tokens, toxicity, url_filter,
)

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

TOKENIZER = "byte_bpe_50k.json"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


@query("op1_packing")
def op1_packing(spark, sf):
    return packing.pack(table(spark, sf, "documents"), tokenizer_path())


@query("op6_token_counts")
def op6_token_counts(spark, sf):
    return tokens.count_tokens(table(spark, sf, "documents"), tokenizer_path())


@query("op9_secret_scan")
def op9_secret_scan(spark, sf):
    return secrets.scan_secrets(table(spark, sf, "documents"))


@query("op10_quality_rules")
def op10_quality_rules(spark, sf):
    docs = table(spark, sf, "documents")
    return quality_rules.judge(docs, quality_rules.train(docs, table(spark, sf, "labels")))


OP4 = r"""WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(list_slice(w, pos, pos + least(10, len(w)) - 1), ' ') AS g
 FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS pos FROM i WHERE len(w) > 0)),
dw AS (SELECT doc_id, n, pos, array_to_string(list_slice(w, pos, pos + n - 1), ' ') AS g FROM (SELECT doc_id, w, n,
 unnest(range(1, len(w) - n + 2)) AS pos FROM d, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n)),
met AS (SELECT doc_id, item_id, pos, n FROM dw JOIN iw USING (n, g)),
hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(pos, pos + n)) AS p FROM met) GROUP BY doc_id),
named AS (SELECT doc_id, list_sort(list(DISTINCT CAST(item_id AS VARCHAR))) AS items FROM met GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(len(items), 0) AS n_items,
 sha256(array_to_string(coalesce(items, []), ',')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
 FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN named USING (doc_id)"""


@query("op4_decontamination", OP4)
def op4_decontamination(spark, sf):
    return decontaminate.find_contamination(table(spark, sf, "documents"), table(spark, sf, "benchmark")).drop("items")


@query("op7_attention_quality")
def op7_attention_quality(spark, sf):
    docs = table(spark, sf, "documents")
    return attention.score(docs, attention.train(docs, table(spark, sf, "labels")))


HOST_RULES = [
    url_filter.host_rule(*rule)
    for rule in (
        ("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
        ("allow", "com", "/fr/"), ("block", "com", "/de/"),
    )
]


def _url_sql() -> str:
    rules = HOST_RULES + [url_filter.pattern_rule(p) for p in url_filter.PATTERNS]
    values = ", ".join(f"('{r.name}', '{r.verdict}', '{r.regex}', {r.of_host}, {len(r.name)})" for r in rules)
    return rf"""WITH p AS (SELECT row_number() OVER () AS row, page_id, translate(regexp_extract(coalesce(url, ''),
 '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
 regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
r(name, verdict, regex, of_host, length) AS (VALUES {values}),
f AS (SELECT p.row, max(row(of_host, length, verdict, name)) AS best FROM p JOIN r
 ON regexp_matches(host || path, regex) GROUP BY p.row)
SELECT page_id, host, path, CASE WHEN best[1] THEN best[4] END AS rule, coalesce(best[3], 'allow') AS verdict,
 CASE WHEN NOT best[1] THEN best[4] END AS pattern FROM p LEFT JOIN f USING (row)"""


@query("op2_url_filter", _url_sql())
def op2_url_filter(spark, sf):
    return url_filter.judge_urls(table(spark, sf, "pages"), HOST_RULES)


OP3 = r"""WITH l AS (SELECT doc_id, line, trim(x, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) AS x FROM (SELECT doc_id,
 unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents)),
f AS (SELECT doc_id, line, x, row_number() OVER (PARTITION BY doc_id ORDER BY line) AS pos FROM l WHERE x <> ''),
u AS (SELECT a.doc_id, a.pos, 3 AS n, a.x || chr(10) || b.x || chr(10) || c.x AS run FROM f a
 JOIN f b ON b.doc_id = a.doc_id AND b.pos = a.pos + 1 JOIN f c ON c.doc_id = a.doc_id AND c.pos = a.pos + 2
 UNION ALL SELECT doc_id, pos, 1, x FROM f WHERE length(x) >= 200),
again AS (SELECT doc_id, pos, n FROM u QUALIFY row_number() OVER (PARTITION BY n, run ORDER BY doc_id, pos) > 1),
gone AS (SELECT DISTINCT doc_id, pos + k AS pos FROM again, (SELECT unnest(range(3)) AS k) WHERE k < n),
kept AS (SELECT l.doc_id, string_agg(d.x, chr(10) ORDER BY l.line) AS rest, count(*) AS n_kept
 FROM l JOIN (SELECT doc_id, unnest(string_split(text, chr(10))) AS x,
 generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents) d USING (doc_id, line)
 LEFT JOIN f ON f.doc_id = l.doc_id AND f.line = l.line LEFT JOIN gone g ON g.doc_id = f.doc_id AND g.pos = f.pos
 WHERE g.pos IS NULL GROUP BY l.doc_id)
SELECT d.doc_id, CASE WHEN coalesce(d.text, '') = '' THEN 0 ELSE len(string_split(d.text, chr(10))) END AS n_lines,
 (SELECT count(*) FROM gone g WHERE g.doc_id = d.doc_id) AS n_removed,
 sha256(coalesce(kept.rest, '')) AS kept_sha256 FROM documents d LEFT JOIN kept USING (doc_id)"""


@query("op3_line_dedup", OP3)
def op3_line_dedup(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    kept = line_dedup.dedup_lines(docs, count_columns=("n_lines", "n_removed"))
    return kept.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


OP5 = r"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''),
 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, p, p + 4), ' ') AS g FROM (SELECT doc_id, w,
 unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS p FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT u, v FROM pairs JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * c >= 85 * (x.n + y.n - c)),
r(doc_id, root) AS (SELECT doc_id, doc_id FROM d UNION SELECT l.v, r.root FROM r JOIN l ON l.u = r.doc_id),
m AS (SELECT doc_id, min(root) AS component_id FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id, d.doc_id = m.component_id AS kept
 FROM d LEFT JOIN n USING (doc_id) JOIN m USING (doc_id)"""


@query("op5_minhash_near_dedup", OP5)
def op5_minhash_near_dedup(spark, sf):
    return near_dedup.near_duplicates(table(spark, sf, "documents")).drop("mark")


@query("op8_suffix_dedup")
def op8_suffix_dedup(spark, sf):
    found = substring_dedup.find_repeats(table(spark, sf, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select(
        "doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


@query("op11_toxicity")
def op11_toxicity(spark, sf):
    docs = table(spark, sf, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf, "labels")))


OP12 = r"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''),
 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT DISTINCT q, item_id, unnest(w) AS t FROM (SELECT row_number() OVER () AS q, item_id, regexp_extract_all(translate(
 coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
 '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM benchmark)),
c AS (SELECT count(*) AS n_docs, CAST(sum(len(w)) AS BIGINT) AS n_terms FROM d WHERE len(w) > 0),
m AS (SELECT r, doc_id, 10 + (90 * len(w) * n_docs) // n_terms AS m FROM d, c WHERE len(w) > 0),
f AS (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(w) AS t FROM d) WHERE t IN (SELECT t FROM i) GROUP BY r, t),
w AS (SELECT t, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1))) AS BIGINT) AS w
 FROM (SELECT t, count(*) AS df FROM f GROUP BY t), c),
s AS (SELECT q, item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
 FROM i JOIN f USING (t) JOIN w USING (t) JOIN m USING (r) GROUP BY q, item_id, r, doc_id),
o AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM s WHERE score > 0)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score FROM o WHERE rank <= 10"""


@query("op12_lexical_search", OP12)
def op12_lexical_search(spark, sf):
    return lexical_search.rank(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


def damaged(rows: DataFrame) -> DataFrame:
    """Conversation rows with the faults that the CRC-32 of `conv_id:turn` deals out; nulls count as one space."""
    known = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")]
    fault = F.crc32(F.concat(known[0], F.lit(":"), known[1])) % 20
    text = F.when(fault == 1, "").when(fault == 2, F.translate(known[3], ".!?", "")).otherwise(known[3])
    role = F.when(fault == 4, "user").otherwise(known[2])
    copies = F.when(fault == 0, 0).when(fault == 3, 2).otherwise(1)
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(0), copies))).drop("col")


@query("op13_conversation_repair")
def op13_conversation_repair(spark, sf):
    rows = table(spark, sf, "conversations")
    found = conversations.repair(damaged(rows))
    every = rows.select("conv_id", conversations.conversation_key("conv_id").alias("key")).distinct()
    counts = [F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return every.join(found.report, "key", "left").join(found.digests(), "key", "left").select(
        "conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )
