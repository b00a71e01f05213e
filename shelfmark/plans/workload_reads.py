"""Registered queries over single lookups, states, conversations and schema evolution."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfmark import functions as fn
from shelfmark.operators import extract as ex
from shelfmark.operators import integrity as integ
from shelfmark.operators import people as ppl
from shelfmark.operators import presentation as pres
from shelfmark.operators import publish as pub
from shelfmark.operators import query as q
from shelfmark.operators import retrieval as ret
from shelfmark.operators import turns as tn
from shelfmark.plans import bind
from shelfmark.plans import oracle as o
from shelfmark.plans.workload import register, utc
from shelfmark.plans.workload_state import (
    LABELS, PEOPLE, PHOTOS, TEXT_SOURCE, _query_vectors, _vectors,
)
from shelfmark.schemas import ENRICHMENT_STATES, STATEMENTS, empty
from shelfmark.sources import tables

MESSAGE_TIME = "make_timestamp((1700000000 + conv_id * 10000 + turn) * 1000000)"


@register("conversation_list", f"""SELECT CAST(conv_id AS VARCHAR) AS id,
      'Conversation ' || conv_id AS title, max({MESSAGE_TIME}) AS updated_at
    FROM conversations GROUP BY conv_id HAVING count(*) FILTER (WHERE role = 'system') = 0""")
def conversation_list(spark, sf_dir):
    """Conversations newest first; those with a system message are archived."""
    rows = bind.messages(spark, sf_dir).groupBy(F.col("conversation_id").alias("id")).agg(
        F.min("created_at").alias("created_at"), F.max("created_at").alias("updated_at"),
        F.max(F.when(F.col("role") == "system", F.col("created_at"))).alias("archived_at"))
    rows = rows.withColumn("title", F.concat(F.lit("Conversation "), "id"))
    return tn.conversation_list(rows).select("id", "title", "updated_at")


@register("transcript", f"""WITH m AS (SELECT conv_id || '-' || turn AS id,
        CAST(conv_id AS VARCHAR) AS conversation_id, role, {MESSAGE_TIME} AS created_at
      FROM conversations)
    SELECT id, conversation_id, role, created_at, resource_ref, ordinal FROM m LEFT JOIN (
      SELECT id, {o.ref(o.uid("'cited|' || id"))} AS resource_ref, 0 AS ordinal FROM m
        WHERE role = 'assistant'
      UNION ALL SELECT id, {o.ref(o.uid("'cited|' || conversation_id"))}, 1 FROM m
        WHERE role = 'assistant') r USING (id)""")
def transcript(spark, sf_dir):
    rows = bind.messages(spark, sf_dir).drop("body")
    cited = rows.filter(F.col("role") == "assistant").select(
        F.col("id").alias("message_id"), F.posexplode(F.array(
            fn.resource_ref(fn.uuid_text(F.lit("cited"), "id")),
            fn.resource_ref(fn.uuid_text(F.lit("cited"), "conversation_id"))))
        .alias("ordinal", "resource_ref"))
    return tn.transcript(rows, cited)


@register("statement_history", f"""WITH {LABELS}
    SELECT {o.ref('id')} AS resource_ref, predicate, value,
      id NOT IN (SELECT id FROM changed) AS is_current, TIMESTAMP '2025-06-01' AS created_at
      FROM old
    UNION ALL SELECT {o.ref('id')}, predicate, value, TRUE, TIMESTAMP '2025-07-01' FROM new
      WHERE id IN (SELECT id FROM changed)""")
def statement_history(spark, sf_dir):
    """Every statement, past ones too, about every labelled resource."""
    old, new = bind.label_statements(spark, sf_dir), bind.label_drafts(spark, sf_dir, True)
    batch = old.select(F.col("subject_asset_id").alias("resource_id")).distinct()
    done = pub.publish(old, new, batch, bind.LABELLER, tuple(bind.LABEL_PREDICATES),
                       bind.SECOND_RUN)
    return pub.statements_of(done.statements, batch, include_history=True).select(
        "resource_ref", "predicate", "value", "is_current", "created_at")


@register("enrichment_states", f"""WITH {o.CATALOG}, {o.JOINED},
    chosen AS (SELECT id, arg_min(external_id, source_id) AS ext FROM joined
      WHERE {TEXT_SOURCE} GROUP BY id)
    SELECT id AS subject_asset_id,
      CASE WHEN l.doc_id IS NULL THEN 'completed' ELSE 'failed' END AS status,
      CASE WHEN l.doc_id IS NOT NULL THEN 'content_changed_since_sync' END AS error_code,
      CASE WHEN l.doc_id IS NULL THEN TIMESTAMP '2025-06-01' END AS completed_at
    FROM chosen LEFT JOIN (SELECT doc_id FROM labels WHERE quality = 0) l
      ON ext = 'doc-' || l.doc_id""")
def enrichment_states(spark, sf_dir):
    """States after an excerpt run in which poorly rated documents changed since the sync."""
    poor = bind.table(spark, sf_dir, "labels").filter("quality = 0").select(
        F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("external_id"),
        F.lit(True).alias("edited"))
    content = bind.document_content(spark, sf_dir).join(poor, "external_id", "left").select(
        "provider", "external_id", F.when(
            F.col("edited"), F.concat("content", F.encode(F.lit("!"), "UTF-8")))
        .otherwise(F.col("content")).alias("content"))
    catalog = bind.catalog(spark, sf_dir)
    extractor = ex.TextExcerpt(content, providers=None)
    run = pub.run_enrichment(extractor, catalog, empty(spark, STATEMENTS),
                             empty(spark, ENRICHMENT_STATES), bind.FIRST_RUN)
    subjects = catalog.resources.select(F.col("id").alias("resource_id"))
    return pub.get_state(run.states, subjects, extractor.generator).select(
        "subject_asset_id", "status", "error_code", "completed_at")


@register("seen_people", f"""WITH {PEOPLE} SELECT external_id, person_id, CASE WHEN NOT known
      THEN 'created' WHEN idle THEN 'reactivated' ELSE 'existing' END AS outcome
    FROM p WHERE c_custkey IN (SELECT o_custkey FROM orders)""")
def seen_people(spark, sf_dir):
    """Customers met in orders become known without ending anyone else."""
    _, persons, sources = bind.people(spark, sf_dir)
    met = bind.table(spark, sf_dir, "orders").select(
        F.concat(F.lit("person-"), F.col("o_custkey").cast("string")).alias("external_id")
    ).distinct()
    return ppl.get_or_create("immich", met, persons, sources, bind.SECOND_RUN).outcomes


FILTERS = ret.RichFilters(provider="immich", captured_from=utc(2022, 3, 1),
                          captured_to=utc(2022, 11, 1), required_predicates=("geo.country",))
NEAREST = """nearest AS (SELECT * FROM (SELECT query_id, vec_id, label, row_number() OVER (
        PARTITION BY query_id ORDER BY list_cosine_similarity(v::DOUBLE[], embedding::DOUBLE[]) DESC,
          'img-' || vec_id) AS rank
      FROM embeddings, (SELECT CAST(label AS BIGINT) AS query_id, arg_min(embedding, vec_id) AS v
        FROM embeddings GROUP BY label)) WHERE rank <= 50)"""
FLAGGED = f"""{PHOTOS}, {NEAREST},
    flagged AS (SELECT query_id, rank, resource_id, captured, label <> 0 AND captured >= TIMESTAMP '2022-03-01'
        AND captured < TIMESTAMP '2022-11-01' AS f1, pair AS f2
      FROM nearest JOIN photos USING (vec_id, label))"""


def _semantic_funnel(spark, sf_dir):
    catalog = bind.catalog(spark, sf_dir)
    found = ret.retrieve_semantic(catalog, _vectors(spark, sf_dir), _query_vectors(spark, sf_dir),
                                  "immich", ret.CANDIDATE_LIMIT)
    return ret.funnel(catalog, bind.statements(spark, sf_dir), ret.semantic_candidates(found),
                      FILTERS, 20, "provider_semantic_primary")


@register("semantic_funnel_hits", f"""WITH {FLAGGED}
    SELECT query_id, {o.ref('resource_id')} AS resource_ref, CAST(rank AS INTEGER) AS source_rank,
      'media.captured_at,geo.country' AS matched, captured AS captured_at
    FROM flagged WHERE f1 AND f2
    QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rank) <= 20""")
def semantic_funnel_hits(spark, sf_dir):
    return _semantic_funnel(spark, sf_dir).hits.select(
        "query_id", "resource_ref", "source_rank", F.array_join("matched_predicates", ",").alias("matched"),
        "captured_at")


@register("semantic_funnel_stages", f"""WITH {FLAGGED}, n AS (SELECT query_id, count(*) AS a,
      count(*) FILTER (WHERE f1) AS b, count(*) FILTER (WHERE f1 AND f2) AS c FROM flagged
      GROUP BY query_id)
    SELECT query_id, 0 AS position, 'provider_semantic_primary' AS stage, 0 AS input_count,
      a AS output_count FROM n
    UNION ALL SELECT query_id, 1, 'source_metadata_filter', a, a FROM n
    UNION ALL SELECT query_id, 2, 'captured_at_filter', a, b FROM n
    UNION ALL SELECT query_id, 3, 'required_predicates_filter', b, c FROM n
    UNION ALL SELECT query_id, 4, 'final_limit', c, least(c, 20) FROM n""")
def semantic_funnel_stages(spark, sf_dir):
    return _semantic_funnel(spark, sf_dir).stages


@register("typed_backfill", f"""WITH {o.CATALOG}
    SELECT id, 'file' AS resource_type, title, created_at FROM resources""")
def typed_backfill(spark, sf_dir):
    """Resources stored before resources had a type, brought to the current schema."""
    old = bind.catalog(spark, sf_dir).resources.drop("resource_type")
    return tables.backfill_resource_type(old).select("id", "resource_type", "title", "created_at")


@register("recent_payload_rows", f"""WITH {o.CATALOG}, {o.JOINED},
    heads AS (SELECT id, row_number() OVER (ORDER BY created_at DESC, id) AS position FROM resources
      WHERE id IN (SELECT id FROM joined) AND created_at < TIMESTAMP '2024-12-01'
        AND created_at >= TIMESTAMP '2024-11-01')
    SELECT position, provider, external_id FROM heads JOIN joined USING (id) WHERE position <= 50""")
def recent_payload_rows(spark, sf_dir):
    """The default recent page (last thirty days, fifty resources) as JSON rows and back."""
    page = q.list_recent(bind.catalog(spark, sf_dir), utc(2024, 12, 1))
    text = pres.rows_as_json(page.rows)
    return text.select(
        fn.json_path("payload", "$.position", "bigint").alias("position"),
        fn.json_string("payload", "$.provider").alias("provider"),
        fn.json_string("payload", "$.external_id").alias("external_id"))


@register("conversation_integrity", """SELECT 'messages' AS table_name, 'check:role' AS rule,
      count(*) AS violations FROM conversations WHERE role = 'system' HAVING count(*) > 0
    UNION ALL SELECT 'turns', 'one_running:conversation_id', count(*) FROM (
      SELECT conv_id FROM conversations WHERE role = 'user' GROUP BY conv_id HAVING count(*) > 1)
      HAVING count(*) > 0""")
def conversation_integrity(spark, sf_dir):
    """Every user message as a running turn: conversations with several break the rule."""
    rows = bind.messages(spark, sf_dir).withColumn("part", F.lit(0).cast("bigint"))
    own = rows.filter(F.col("role") == "user")
    none = F.lit(None).cast("string")
    turns = own.select(
        fn.uuid_text(F.lit("turn"), "id").alias("id"), "conversation_id",
        F.col("id").alias("user_message_id"), none.alias("assistant_message_id"),
        F.lit("running").alias("status"), F.col("created_at").alias("started_at"),
        F.lit(None).cast("timestamp").alias("completed_at"), none.alias("error_code"))
    conversations = rows.groupBy(F.col("conversation_id").alias("id")).agg(
        F.min("created_at").alias("created_at"), F.max("created_at").alias("updated_at")).select(
        "id", F.col("id").alias("title"), "created_at", "updated_at",
        F.lit(None).cast("timestamp").alias("archived_at"))
    return integ.check_integrity({
        "conversations": conversations, "messages": rows, "turns": turns}).filter("violations > 0")
