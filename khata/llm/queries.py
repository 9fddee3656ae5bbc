"""The registered queries of the operators, op1 to op13, and DuckDB texts where SQL can express them."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from khata.llm import (bpe, decontaminate, fixity, jaccard_join, main_text, manifest, quality, secret_scan, sharding, spelling, substrings,
                       toxicity, url_filter)
from khata.llm.frames import kept, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return add


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _secret_sql() -> str:
    parts = []
    for order, r in enumerate(secret_scan.RULES):
        parts.append(f"""
        SELECT doc_id, {order} AS ord, '{r.kind}' AS kind, list_sum(list_transform(p[1:i], lambda x: length(x)))
            + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS s, length(m[i]) AS n
        FROM (SELECT doc_id, m, g, p, unnest(range(1, len(m) + 1)) AS i FROM (
            SELECT doc_id, regexp_extract_all(text, {quoted(r.pattern)}, 0) AS m,
                regexp_extract_all(text, {quoted(r.pattern)}, {r.group}) AS g,
                string_split_regex(text, {quoted(r.pattern)}) AS p
            FROM documents WHERE regexp_matches(text, {quoted(r.pattern)})))
        WHERE length(g[i]) >= {r.least}""")
    listed = "string_agg(kind || ':' || s || ':' || (s + n), ',' ORDER BY s, ord)"
    return f"""WITH found AS ({' UNION ALL '.join(parts)})
    SELECT d.doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
        count(*) FILTER (kind = 'hex') AS n_hex,
        sha256(coalesce({listed} FILTER (ord < 3), '')) AS base_sha256, coalesce({listed}, '') AS spans
    FROM documents d LEFT JOIN found USING (doc_id) GROUP BY d.doc_id"""


@query("op1_secret_scan", _secret_sql())
def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document; the first three kinds are the base ones."""
    found = secret_scan.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["order"] < 3)
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("row.doc_id", *[count(r.kind) for r in secret_scan.RULES[:3]],
                        F.sha2(secret_scan.listed(base), 256).alias("base_sha256"),
                        secret_scan.listed(F.col("spans")).alias("spans"))


def _url_sql() -> str:
    def glob(g: str) -> str:
        return "(?s)" + "".join({"**": ".*", "*": "[^/]*", "?": "[^/]"}.get(t, re.escape(t)) for t in re.findall(r"\*\*+|\*|\?|.", g))

    rules = sorted(url_filter.SITE_RULES, key=lambda r: -len(r.name))
    fits = lambda r: f"regexp_full_match('.' || host || path, {quoted(glob(r.glob))})"
    case = lambda rs, value, other: "CASE " + " ".join(f"WHEN {fits(r)} THEN {quoted(value(r))}" for r in rs) + f" ELSE {other} END"
    return f"""WITH parts AS (SELECT page_id,
        CASE WHEN contains(url, '://') THEN translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1),
            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
        CASE WHEN contains(url, '://') THEN regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) ELSE '' END AS path FROM pages)
    SELECT page_id, host, path, {case(rules, lambda r: r.name, 'NULL')} AS rule,
        {case([*rules, *url_filter.WORD_RULES], lambda r: r.verdict, "'allow'")} AS verdict FROM parts"""


@query("op2_url_filter", _url_sql())
def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page."""
    judged = url_filter.judge(table(spark, sf_dir, "pages"), "page_id", "url")
    return judged.select(F.col("key").alias("page_id"), "host", "path", "rule", "verdict")


@query("op7_sharding")
def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards 0 to 15 of equal weight for every document, its place in the shard, and its shard when there are 17."""
    docs = table(spark, sf_dir, "documents")
    dealt = sharding.assign(docs.select(
        "doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32")), "doc_id", [1.0] * 16)
    placed = sharding.numbered(dealt.select("row.*", "shard", "grown_shard"), "shard", "doc_id", "text_crc32", "size")
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


@query("op9_quality_rules")
def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures and verdicts of the quality rules for every document."""
    return quality.rate(table(spark, sf_dir, "documents")).withColumnRenamed("key", "doc_id")


def held_out() -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2


@query("op10_toxicity")
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document, learned from the labels that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").where(~held_out()))
    scored = toxicity.score(docs, model).select("row.doc_id", "score", "abuse_hits", "misspelled_hits", "quoted_hits")
    return scored.select("doc_id", held_out().alias("held_out"), "score",
                         (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"),
                         "abuse_hits", "misspelled_hits", "quoted_hits")


@query("op5_bpe")
def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document: their number, and digests of the ids and of the decoded text."""
    import public_tokenizers

    digests = ("n_tokens", "ids_sha256", "decoded_sha256")
    coded = bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"),
                       public_tokenizers.path("word_bpe_49k.json"), outputs=digests)
    return coded.select("row.doc_id", *digests)


CONTRACT_LIKENESS = jaccard_join.Likeness(words=3, part=90, whole=100)

_JACCARD_SQL = r"""WITH RECURSIVE words AS (
    SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
sets AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) END) AS s FROM words),
grams AS (SELECT doc_id, len(s) AS n, hash(unnest(s)) AS g FROM sets),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared, any_value(a.n) + any_value(b.n) AS total
    FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id < b.doc_id AND 100 * a.n >= 90 * b.n AND 100 * b.n >= 90 * a.n GROUP BY x, y),
links AS (SELECT x, y FROM pairs WHERE 100 * shared >= 90 * (total - shared)),
edges AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, e.y FROM reach r JOIN edges e ON r.y = e.x),
least AS (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY x)
SELECT s.doc_id, len(s.s) AS n_shingles, component_id FROM sets s JOIN least USING (doc_id)"""


@query("op8_jaccard_join", _JACCARD_SQL)
def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose sets of three-word shingles overlap to nine tenths."""
    found = jaccard_join.join(table(spark, sf_dir, "documents"), like=CONTRACT_LIKENESS)
    return found.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


@query("op3_decontaminate")
def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item found in a document, with its place and edits."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.leaks(docs, table(spark, sf_dir, "benchmark"))
    one = found.select("row.doc_id", F.explode("leaks").alias("leak"))
    return one.select("doc_id", F.col("leak.item").alias("item_id"), "leak.start", "leak.end", "leak.edits")


#: The second replica of the pages: every 97th record has a byte turned, every 193rd has been lost.
TURNED, LOST = (97, 13), (193, 7)

_FIXITY_SQL = f"""WITH records AS (SELECT page_id, page_id // {fixity.PER_ARCHIVE} AS archive,
    'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || page_id
    || '>' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10) || 'Content-Length: '
    || strlen(coalesce(html, '')) || chr(13) || chr(10) || chr(13) || chr(10) || coalesce(html, '') || chr(13) || chr(10)
    || chr(13) || chr(10) AS r FROM pages),
placed AS (SELECT page_id, archive, page_id - archive * {fixity.PER_ARCHIVE} AS number, CAST(sum(strlen(r)) OVER w - strlen(r) AS BIGINT) AS "start",
    CAST(sum(strlen(r)) OVER w AS BIGINT) AS "end", sha256(r) AS first_digest FROM records
    WINDOW w AS (PARTITION BY archive ORDER BY page_id ROWS UNBOUNDED PRECEDING))
SELECT page_id, archive, number, "start", "end", CASE WHEN page_id % {LOST[0]} = {LOST[1]} THEN 'missing' ELSE 'changed' END AS status,
    first_digest FROM placed WHERE page_id % {LOST[0]} = {LOST[1]} OR page_id % {TURNED[0]} = {TURNED[1]}"""


@query("op4_merkle_fixity", _FIXITY_SQL)
def op4_merkle_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Damage of a second replica of all pages, from which records are lost and in which bytes are turned, located by Merkle trees."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    every = lambda n: F.coalesce(F.pmod("page_id", F.lit(n[0])) == n[1], F.lit(False))
    turned = pages.where(~every(LOST)).withColumn("html", F.when(every(TURNED), F.overlay("html", F.lit("~"), F.lit(1))).otherwise(F.col("html")))
    whole = kept(fixity.manifest(pages, "page_id", "url", "html"), "replica1-manifest")
    found = fixity.audit(fixity.tree(whole, "replica1"), fixity.tree(fixity.manifest(turned, "page_id", "url", "html"), "replica2"))
    return found.join(whole.select("archive", "number", "start", "end"), ["archive", "number"]).select(
        (F.col("archive") * fixity.PER_ARCHIVE + F.col("number")).alias("page_id"), "archive", "number", "start", "end", "status", "first_digest")


_SUBSTRING_SQL = r"""WITH words AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'),
        lambda w: w <> '') AS w FROM documents),
runs AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 12], ' ')) AS g FROM (
    SELECT doc_id, w, unnest(range(1, greatest(len(w) - 11, 1))) AS i FROM words)),
firsts AS (SELECT g, min(doc_id) AS first FROM runs GROUP BY g),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS spot FROM runs JOIN firsts USING (g) WHERE doc_id > first),
lists AS (SELECT doc_id, list(spot) AS places, count(*) AS n_removed FROM gone GROUP BY doc_id),
stays AS (SELECT w.doc_id, w, coalesce(n_removed, 0) AS n_removed, coalesce(places, []) AS places FROM words w LEFT JOIN lists USING (doc_id)),
each AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS spot FROM stays),
left_over AS (SELECT e.doc_id, string_agg(word, ' ' ORDER BY e.spot) AS text FROM each e ANTI JOIN gone g ON e.doc_id = g.doc_id AND e.spot = g.spot
    GROUP BY e.doc_id)
SELECT s.doc_id, len(w) AS n_words, n_removed, sha256(coalesce(l.text, '')) AS kept_sha256 FROM stays s LEFT JOIN left_over l USING (doc_id)"""


@query("op6_substring_dedup", _SUBSTRING_SQL)
def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of every document earlier documents already have, in windows of 13 words."""
    found = substrings.repeats(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_words", "n_removed", "kept_sha256")


def _crc32_sql(codes: str) -> str:
    """Unsigned CRC-32 of a list of bytes, bit by bit."""
    bits = "list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {codes}), lambda c, b: {bits}), 4294967295)"


def _manifest_sql() -> str:
    framed = lambda c: f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || {c}, '-')"
    row_hash = lambda text: "sha256(" + " || ".join(map(framed, ["doc_id", "source", "lang", "n_chars", text])) + ")"
    digits = "list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda d: CAST(ascii(d) AS BIGINT))"
    levels = lambda start: f"""{start} UNION ALL SELECT grp, level + 1, pos // 8, sha256(string_agg(h, '' ORDER BY pos)) FROM (
        SELECT *, count(*) OVER (PARTITION BY grp) AS many FROM %s) WHERE many > 1 GROUP BY grp, level, pos // 8"""  # noqa: E731
    runs = lambda name: f"SELECT grp, level, pos // 8 AS run, list(h ORDER BY pos) AS hs FROM {name} GROUP BY ALL"
    path = lambda rows, name, step: f"""SELECT r.id, {step} + n.level AS level, array_to_string(hs[1:(r.pos // (8 ** n.level)::BIGINT) % 8], '') AS l,
        array_to_string(hs[(r.pos // (8 ** n.level)::BIGINT) % 8 + 2:], '') AS r
        FROM {rows} r JOIN {name} n ON n.grp = r.grp AND n.run = r.pos // (8 ** (n.level + 1))::BIGINT
        WHERE n.level < (SELECT max(level) FROM {name} m WHERE m.grp = r.grp)"""  # noqa: E731
    return f"""WITH RECURSIVE hashed AS (SELECT doc_id, coalesce('=' || lang, '') AS grp, {row_hash('text')} AS leaf,
        CASE WHEN {_crc32_sql(digits)} % 3 = 0 THEN {row_hash(f"translate(text, '{spelling.CAPITALS[0]}', '{spelling.CAPITALS[1]}')")} END AS other FROM documents),
    leaves AS (SELECT *, row_number() OVER () AS id, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM hashed),
    nodes AS ({levels("SELECT grp, 0 AS level, pos, leaf AS h FROM leaves") % "nodes"}),
    subroots AS (SELECT grp AS name, h, row_number() OVER (ORDER BY grp) - 1 AS pos FROM nodes n
        WHERE level = (SELECT max(level) FROM nodes m WHERE m.grp = n.grp)),
    top AS ({levels("SELECT '' AS grp, 0 AS level, pos, h FROM subroots") % "top"}),
    node_runs AS ({runs("nodes")}), top_runs AS ({runs("top")}),
    named AS (SELECT id, '' AS grp, s.pos FROM leaves l JOIN subroots s ON s.name = l.grp),
    steps AS ({path("leaves", "node_runs", 0)} UNION ALL {path("named", "top_runs", 100)}),
    ordered AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY level) AS step FROM steps),
    fold AS (SELECT id, 0 AS step, coalesce(other, leaf) AS h FROM leaves
        UNION ALL SELECT f.id, f.step + 1, sha256(o.l || f.h || o.r) FROM fold f JOIN ordered o ON o.id = f.id AND o.step = f.step + 1),
    ends AS (SELECT id, max_by(h, step) AS h FROM fold GROUP BY id),
    proofs AS (SELECT id, string_agg(l || r, '' ORDER BY level) AS p FROM steps GROUP BY id),
    root AS (SELECT max_by(h, level) AS root FROM top)
    SELECT doc_id, leaf, s.h AS subroot, root, sha256(coalesce(p, '')) AS proof_sha256, e.h AS folded_root, e.h = root AS verified
    FROM leaves l JOIN subroots s ON s.name = l.grp JOIN ends e USING (id) LEFT JOIN proofs USING (id), root"""


def manifest_rows(docs: DataFrame) -> DataFrame:
    """Manifest of documents, and what every proof says about a copy in which some texts have lost their capitals."""
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    lowered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0,
                     manifest.leaf(*[F.translate("text", *spelling.CAPITALS) if c == "text" else F.col(c) for c in fields]))
    found = manifest.manifest(docs, "doc_id", "lang", fields, {"doc_id": F.col("doc_id"), "other": lowered})
    siblings = F.array_join(F.transform("path", lambda s: F.concat(s["left"], s["right"])), "")
    again = manifest.folded(F.coalesce("carried.other", "leaf"), F.col("path"))
    return found.select("carried.doc_id", "leaf", "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"),
                        again.alias("folded_root")).withColumn("verified", F.col("folded_root") == F.col("root"))


@query("op13_merkle_manifest", _manifest_sql())
def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, subroot, root and proof of every document, and whether a tampered copy of it still verifies."""
    return manifest_rows(table(spark, sf_dir, "documents"))


def _spelling_sql() -> str:
    codes = """flatten(list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run, ''), lambda ch:
        CASE WHEN unicode(ch) < 128 THEN [CAST(unicode(ch) AS BIGINT)] ELSE [195::BIGINT, unicode(ch) - 64] END))"""
    return f"""WITH RECURSIVE found AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '{spelling.LETTERS}+')),
        '{spelling.CAPITALS[0]}', '{spelling.CAPITALS[1]}') AS run FROM documents),
    runs AS (SELECT doc_id, run, count(*) AS times FROM found WHERE length(run) >= 7 GROUP BY ALL),
    hashed AS (SELECT run, times, {_crc32_sql(codes)} AS h FROM runs),
    cut AS (SELECT times, CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM hashed),
    words AS (SELECT word, CAST(sum(times) AS BIGINT) AS n FROM cut WHERE length(word) >= 7 GROUP BY word HAVING sum(times) >= 2),
    spots AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words),
    gaps AS (SELECT word, n, i, substr(word, 1, i - 1) || '*' || substr(word, i + 1) AS other,
        substr(word, 1, i - 1) || substr(word, i + 1) AS less FROM spots),
    less AS (SELECT DISTINCT g.word, g.n, w.word AS near, w.n AS near_n FROM gaps g JOIN words w ON g.less = w.word),
    near AS (SELECT a.word, a.n, b.word AS near, b.n AS near_n FROM gaps a JOIN gaps b ON a.other = b.other AND a.word <> b.word
        UNION ALL FROM less UNION ALL SELECT near, near_n, word, n FROM less),
    tops AS (SELECT word, near, near_n, count(*) OVER (PARTITION BY word) AS n_near,
        row_number() OVER (PARTITION BY word ORDER BY near_n DESC, near) AS place FROM near),
    forms AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 10 * n THEN near END AS form,
        CASE WHEN near_n >= 10 * n THEN near_n END AS form_n FROM words w LEFT JOIN (FROM tops WHERE place = 1) t USING (word)),
    chain AS (SELECT word, word AS root, 0 AS step FROM forms
        UNION ALL SELECT c.word, f.form, step + 1 FROM chain c JOIN forms f ON f.word = c.root WHERE f.form IS NOT NULL),
    roots AS (SELECT word, max_by(root, step) AS root FROM chain GROUP BY word)
    SELECT word, form, root, n, n_near, form_n FROM forms JOIN roots USING (word)"""


@query("op11_spelling_variants", _spelling_sql())
def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of the documents with its number of near words, the form it varies, and the root of that."""
    return spelling.groups(table(spark, sf_dir, "documents"))


@query("op12_html_extraction")
def op12_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    found = main_text.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("row.page_id", "row.url", "text", "n_chars")
