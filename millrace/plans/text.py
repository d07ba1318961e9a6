"""Text and vector queries over the fixture tables; fixture-derived.

Near-duplicate search, decontamination and the like are not here: operators of
that kind are those of the training-data subpackage alone.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators.vectors import assigned, fit, nearest, search
from millrace.plans.registry import query
from millrace.session import table


@query(
    "p62_line_signals",
    r"""WITH l AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: x <> '') AS ls, text FROM documents)
        SELECT doc_id, CAST(len(ls) AS BIGINT) AS lines, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS repeated,
               CAST(len(regexp_extract_all(text, '[0-9]')) AS BIGINT) AS digits FROM l""",
)
def line_signals(spark, sf_dir):
    lines = F.filter(F.split("text", "\n"), lambda x: x != "")
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        F.size(lines).cast("long").alias("lines"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("repeated"),
        F.regexp_count("text", F.lit("[0-9]")).cast("long").alias("digits"),
    )


@query(
    "p65_html_text",
    r"""SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS host,
               md5(trim(regexp_replace(regexp_replace(regexp_replace(html, '<(script|style)[^>]*>[\s\S]*?</(script|style)>', ' ', 'g'),
                   '<[^>]*>', ' ', 'g'), '[ \t\r\n]+', ' ', 'g'), ' ')) AS text_md5 FROM pages""",
)
def html_text(spark, sf_dir):
    plain = F.regexp_replace("html", r"<(script|style)[^>]*>[\s\S]*?</(script|style)>", " ")
    plain = F.regexp_replace(F.regexp_replace(plain, "<[^>]*>", " "), "[ \t\r\n]+", " ")
    return table(spark, sf_dir, "pages").select("page_id", F.parse_url("url", F.lit("HOST")).alias("host"), F.md5(F.trim(plain)).alias("text_md5"))


@query(
    "p66_label_confusion",
    """SELECT quality, length(text) > 1000 AS is_long, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY ALL""",
)
def label_confusion(spark, sf_dir):
    joined = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    return joined.groupBy("quality", (F.length("text") > 1000).alias("is_long")).agg(F.count("*").alias("n"))


@query(
    "p68_vector_topk",
    """WITH p AS (SELECT q.vec_id AS query_id, e.vec_id, list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])) AS dot
                  FROM (SELECT * FROM embeddings WHERE vec_id % 20 = 0) q JOIN embeddings e ON q.vec_id <> e.vec_id)
       SELECT query_id, vec_id, round(dot, 6) AS dot FROM p
       QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(dot, 6) DESC, vec_id) <= 5""",
)
def vector_topk(spark, sf_dir):
    """The five nearest of every vector, for the query set of ids divisible by 20."""
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where("vec_id % 20 = 0"), 5)


@query("p69_vector_index")
def vector_index(spark, sf_dir):
    """The same by an inverted file over all vectors; recall is measured against p68_vector_topk."""
    vectors = table(spark, sf_dir, "embeddings")
    index = fit(vectors, 5)
    return search(index, assigned(vectors, index), vectors.where("vec_id % 20 = 0"), 5)
