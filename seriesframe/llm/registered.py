"""The registered queries of this package and their SQL."""

from __future__ import annotations

import hashlib

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesframe.llm import (
    bpe, fingerprints, langid, lines, neardup, packing, pii, rules, sites, spelling, substrings, urls, vectorcodes,
)

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")


def register(name: str, sql: str | None = None):
    def add(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _hex(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


@register("op1_language")
def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every text, by profiles of the documents that are not held out."""
    docs = table(spark, sf_dir, "documents")
    profiles = langid.learn(docs.filter(~langid.held_out()))
    made = langid.identify(docs, profiles)
    return made.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


@register("op2_bpe")
def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text encoded and decoded; ids and decoded text as digests."""

    def digest(ids, decoded):
        text = decoded.decode("utf-8", "replace").encode()
        return len(ids), _hex(ids.astype("<u4").tobytes()), _hex(text)

    return bpe.encode_documents(
        table(spark, sf_dir, "documents"), BYTE_BPE, finish=digest,
        schema="n_tokens long, ids_sha256 string, decoded_sha256 string",
    )


URL_RULES = [
    urls.Rule(urls.BLOCK, "net", "/"),
    urls.Rule(urls.ALLOW, "example.net", "/en/"),
    urls.Rule(urls.BLOCK, "example.com", "/de/"),
    urls.Rule(urls.ALLOW, "org", "/fr/"),
]
_FITS = " ".join(
    f"WHEN (host = '{r.host}' OR host LIKE '%.{r.host}') AND starts_with(path, '{r.path}') "
    f"THEN '{r.name}'"
    for r in sorted(URL_RULES, key=lambda r: -len(r.name))
)
_VERDICTS = " ".join(f"WHEN '{r.name}' THEN '{r.verdict}'" for r in URL_RULES)


@register("op3_url_filter", f"""
    WITH cut AS (
        SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3)
            ELSE '' END AS rest FROM pages
    ), hosts AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM cut
    ), parts AS (
        SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')
            AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM hosts
    ), ruled AS (SELECT page_id, host, path, CASE {_FITS} END AS rule FROM parts)
    SELECT page_id, host, path, rule, CASE rule {_VERDICTS} ELSE 'allow' END AS verdict FROM ruled
""")
def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, longest fitting rule and verdict of every page."""
    return urls.filter_urls(table(spark, sf_dir, "pages"), URL_RULES)


@register("op5_site_quality")
def op5_site_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probability of good quality of every document, from its text and its site's record."""
    return sites.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@register("op6_packing")
def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces and their places in sequences of 1024 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"), BYTE_BPE, with_ids=False)


@register("op7_quality_rules")
def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counted facts and the verdict of base rules and classifier for every document."""
    docs = table(spark, sf_dir, "documents")
    return rules.apply_rules(docs, rules.train(docs, table(spark, sf_dir, "labels")))


@register("op10_fingerprints")
def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every text and its edited text; the edited text as a digest."""
    made = fingerprints.compare_edited(table(spark, sf_dir, "documents"))
    return made.select(
        "doc_id", "n_chars", F.sha2(F.col("edited_text").cast("binary"), 256).alias("edited_sha256"),
        "fingerprint", "edited_fingerprint", "near_edited", "near_next",
    )


@register("op8_pii")
def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every text: base counts, a digest of the base spans, and all spans."""
    made = pii.find_pii(table(spark, sf_dir, "documents"))

    def number(kind: str):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [number(kind) for kind in pii.KINDS]
    base = pii.written(F.col("base")).cast("binary")
    return made.select(
        "doc_id", *counts, F.sha2(base, 256).alias("base_sha256"), pii.written(F.col("spans")).alias("spans")
    )


@register("op4_near_duplicates")
def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate class of every document."""
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


@register("op9_line_dedup")
def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class of every line that is not blank, and which line of each class comes first."""
    return lines.line_classes(table(spark, sf_dir, "documents"), min_chars=lines.ALL_LINES)


def _codes_sql(rounds: int) -> str:
    """Rounds of assignment and averaging, each as two common tables."""

    def near(k: int) -> str:
        return f"""
        near{k} AS MATERIALIZED (
            SELECT vec_id, x.p, arg_min(e, apart * {vectorcodes.ENTRIES} + e) AS e, min(apart)::BIGINT AS apart
            FROM (SELECT vec_id, parts.p, e, list_inner_product(x, x) + list_inner_product(y, y)
                      - 2 * list_inner_product(x, y) AS apart
                  FROM parts JOIN book{k} USING (p)) x GROUP BY vec_id, x.p
        )"""

    def book(k: int) -> str:
        return f"""
        sums{k} AS MATERIALIZED (
            SELECT p, e, i, sum(x[i])::BIGINT AS s, count(*) AS n
            FROM near{k} JOIN parts USING (vec_id, p), range(1, len(x) + 1) r(i) GROUP BY ALL
        ), new{k} AS (
            SELECT p, e, list(((s - ((s % n) + n) % n) // n)::DOUBLE ORDER BY i) AS y FROM sums{k} GROUP BY p, e
        ), book{k + 1} AS MATERIALIZED (
            SELECT p, e, coalesce(new{k}.y, book{k}.y) AS y FROM book{k} LEFT JOIN new{k} USING (p, e)
        )"""

    steps = ",".join(f"{near(k)},{book(k)}" for k in range(rounds))
    return f"""
        WITH kept AS MATERIALIZED (
            SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
            WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), parts AS MATERIALIZED (
            SELECT vec_id, p::INT AS p, v[p * (len(v) // 4) + 1 : (p + 1) * (len(v) // 4)] AS x
            FROM kept, range({vectorcodes.PARTS}) r(p)
        ), firsts AS (
            SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept
            QUALIFY row_number() OVER (ORDER BY vec_id) <= {vectorcodes.ENTRIES}
        ), book0 AS MATERIALIZED (SELECT p, e, x AS y FROM firsts JOIN parts USING (vec_id)
        ),{steps},{near(rounds)}, coded AS (
            SELECT vec_id, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(apart)::BIGINT AS error
            FROM near{rounds} GROUP BY vec_id
        )
        SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
            (SELECT sha256(string_agg(c::BIGINT::VARCHAR, ',' ORDER BY p, e, i))
             FROM (SELECT p, e, unnest(y) AS c, generate_subscripts(y, 1) AS i FROM book{rounds}))
            AS codebooks_sha256
        FROM coded JOIN kept USING (vec_id)"""


@register("op11_vector_codes", _codes_sql(vectorcodes.ROUNDS))
def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code and errors of every vector, and a digest of the codebooks."""
    made, books = vectorcodes.compress(table(spark, sf_dir, "embeddings"))
    code = F.array_join(F.transform("codes", lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))), "")
    return made.select(
        "vec_id", code.alias("code"), "error", "label_error",
        F.lit(vectorcodes.digest(books)).alias("codebooks_sha256"),
    )


@register("op12_substrings", f"""
    WITH words AS MATERIALIZED (
        SELECT doc_id, pos, word FROM (
            SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos
            FROM (SELECT doc_id, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS w FROM documents))
    ), windows AS MATERIALIZED (
        SELECT doc_id, pos, sha256(array_to_string(list(word) OVER w, ' ')) AS h FROM words
        WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND {substrings.WINDOW - 1} FOLLOWING)
        QUALIFY count(*) OVER w = {substrings.WINDOW}
    ), firsts AS (SELECT h, min(doc_id) AS first FROM windows GROUP BY h
    ), again AS (SELECT doc_id, pos, true AS again FROM windows JOIN firsts USING (h) WHERE first < doc_id
    ), marked AS (
        SELECT doc_id, pos, word, count(again) OVER (PARTITION BY doc_id ORDER BY pos
            ROWS BETWEEN {substrings.WINDOW - 1} PRECEDING AND CURRENT ROW) > 0 AS gone
        FROM words LEFT JOIN again USING (doc_id, pos)
    )
    SELECT d.doc_id, count(m.pos) AS n_words, count(*) FILTER (m.gone) AS n_removed,
        sha256(coalesce(string_agg(m.word, ' ' ORDER BY m.pos) FILTER (NOT m.gone), '')) AS kept_sha256
    FROM documents d LEFT JOIN marked m USING (doc_id) GROUP BY d.doc_id
""")
def op12_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every text, those in passages of 50 words seen before, and a digest of the others."""
    made = substrings.drop_repeats(table(spark, sf_dir, "documents"))
    digest = F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256")
    return made.select("doc_id", "n_words", "n_removed", digest)


# One in so many runs of a document loses a letter before they are counted.
MISSPELL = 199


@register("op13_spelling", f"""
    WITH RECURSIVE tab AS (
        SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, k:
            CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
    ), runs AS (
        SELECT coalesce(doc_id::VARCHAR, '') AS doc, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
            'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n
        FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')) AS run FROM documents)
        GROUP BY ALL
    ), hashed AS (
        SELECT run, n, xor(list_reduce(list_prepend(4294967295, flatten(list_transform(
            string_split(doc || ':' || run, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT]
            ELSE [(192 | (unicode(c) >> 6))::BIGINT, (128 | (unicode(c) & 63))::BIGINT] END))),
            lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS h
        FROM runs, tab
    ), words AS MATERIALIZED (
        SELECT word, sum(n)::BIGINT AS n FROM (
            SELECT CASE WHEN h % {MISSPELL} = 0 THEN substr(run, 1, (h % length(run))::INT)
                || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, n FROM hashed)
        WHERE length(word) >= {spelling.MIN_CHARS} GROUP BY word HAVING sum(n) >= {spelling.MIN_COUNT}
    ), cut AS MATERIALIZED (
        SELECT word, n, substr(word, 1, i - 1) || '_' || substr(word, i + 1) AS hole,
            substr(word, 1, i - 1) || substr(word, i + 1) AS rest
        FROM (SELECT word, n, unnest(range(1, length(word) + 1))::INT AS i FROM words)
    ), pairs AS (
        SELECT a.word, b.word AS near, b.n FROM cut a JOIN cut b USING (hole) WHERE a.word <> b.word
        UNION SELECT a.word, b.word, b.n FROM cut a JOIN words b ON a.rest = b.word
        UNION SELECT b.word, a.word, a.n FROM cut a JOIN words b ON a.rest = b.word
    ), best AS (
        SELECT word, count(*) AS n_near, (list(near ORDER BY n DESC, near))[1] AS near, max(n) AS top
        FROM pairs GROUP BY word
    ), formed AS MATERIALIZED (
        SELECT word, words.n, coalesce(n_near, 0)::BIGINT AS n_near,
            CASE WHEN top >= {spelling.RATIO} * words.n THEN near END AS form,
            CASE WHEN top >= {spelling.RATIO} * words.n THEN top END AS form_n
        FROM words LEFT JOIN best USING (word)
    ), chain(word, root) AS (
        SELECT word, word FROM formed WHERE form IS NULL
        UNION ALL SELECT f.word, c.root FROM formed f JOIN chain c ON f.form = c.word
    )
    SELECT word, form, root, n, n_near, form_n FROM formed JOIN chain USING (word)
""")
def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every frequent word, the more frequent word it may be a misspelling of, and the end of that chain."""
    return spelling.variants(table(spark, sf_dir, "documents"), misspell=MISSPELL)
