"""SQL fragments that state the binding of the test tables a second time, for DuckDB."""

from __future__ import annotations


def uid(expr: str) -> str:
    """UUID-shaped id of a natural key."""
    h = f"sha256({expr})"
    return (f"({h}[1:8] || '-' || {h}[9:12] || '-' || {h}[13:16] || '-' || {h}[17:20] || '-' || "
            f"{h}[21:32])")


def instant(start: str, offset: str) -> str:
    return f"(TIMESTAMP '{start}' + to_seconds(CAST(({offset}) % 31536000 AS BIGINT)))"


def size(expr: str) -> str:
    return f"CAST(octet_length(encode({expr})) AS BIGINT)"


def documents(scan: int) -> str:
    second = scan == 2
    poor = "coalesce(l.quality, 1) = 0"
    body = f"CASE WHEN {poor} THEN text || ' (revised)' ELSE text END" if second else "text"
    version = "'v-' || n_chars" + (f" || CASE WHEN {poor} THEN '-2' ELSE '' END" if second else "")
    leaf = "CASE WHEN lang = 'de' THEN 'renamed-' ELSE 'doc-' END" if second else "'doc-'"
    ext = ("CASE WHEN lang = 'fr' THEN '.md' WHEN lang IN ('en', 'de') THEN '.txt' "
           "WHEN n_chars % 2 = 1 THEN '.bin' ELSE '' END")
    source = ("documents d LEFT JOIN labels l USING (doc_id) WHERE coalesce(l.toxic, 0) = 0"
              if second else "documents d")
    modified = instant("2023-01-01",
                       "n_chars * 3607 + CASE WHEN lang = 'fr' THEN doc_id ELSE 0 END")
    return f"""
      SELECT doc_id * 4 AS ordinal, source AS provider, 'file' AS kind,
        'doc-' || doc_id AS external_id, {leaf} || doc_id || {ext} AS name,
        '/' || lang || '/' || source || '/' || {leaf} || doc_id || {ext} AS path,
        {size(body)} AS size,
        CASE lang WHEN 'en' THEN 'text/plain' WHEN 'fr' THEN 'text/markdown'
          WHEN 'de' THEN 'TEXT/Plain; charset=utf-8'
          ELSE CASE WHEN n_chars % 2 = 1 THEN 'malformed' END END AS mime_type,
        {version} AS version_tag, {body} AS body,
        CASE WHEN lang = 'es' AND n_chars % 2 = 1 THEN NULL ELSE {modified} END AS modified_at,
        lang AS meta
      FROM {source}"""


def pages(provider: str, prefix: str, slot: int) -> str:
    return f"""
      SELECT page_id * 4 + {slot}, '{provider}', 'file', '{prefix}-' || page_id,
        '{prefix}-' || page_id || '.html', '/' || regexp_replace(url, '^https?://', ''),
        {size('html')}, 'text/html', '1', html, NULL::TIMESTAMP, url FROM pages"""


def photos(scan: int) -> str:
    moved = "CASE WHEN label = 3 THEN 60 ELSE 0 END" if scan == 2 else "0"
    return f"""
      SELECT vec_id * 4 + 2, 'immich', 'file', 'img-' || vec_id, 'IMG_' || vec_id || '.jpg',
        '/photos/' || label || '/IMG_' || vec_id || '.jpg', {size("'photo-' || vec_id")},
        'image/jpeg', 'p-' || label, 'photo-' || vec_id,
        {instant('2022-06-01', f'vec_id * 40009 + {moved}')}, '' FROM embeddings"""


def messages(scan: int) -> str:
    tail = "CASE WHEN role = 'system' THEN ' (edited)' ELSE '' END" if scan == 2 else "''"
    body = (f"'From: ' || role || '@example.org' || chr(13) || chr(10) || 'To: team@example.org' "
            f"|| chr(13) || chr(10) || 'Subject: Conversation ' || conv_id || chr(13) || chr(10) "
            f"|| chr(9) || 'turn ' || turn || chr(13) || chr(10) || chr(13) || chr(10) || text "
            f"|| {tail}")
    return f"""
      SELECT (conv_id * 10000 + turn) * 4 + 3, 'gmail', 'message',
        'msg-' || conv_id || '-' || turn, 'Conversation ' || conv_id || ' turn ' || turn, NULL,
        {size(body)}, 'message/rfc822', NULL, {body}, NULL::TIMESTAMP, '' FROM conversations"""


ITEMS = f"""
      SELECT item_id * 4 + 2000000000000, 'src0', 'file', 'item-' || item_id,
        'item-' || item_id || '.txt', '/items/item-' || item_id || '.txt', {size('text')},
        'text/plain', '1', text, NULL::TIMESTAMP, '' FROM benchmark"""


def facts(scan: int) -> str:
    parts = [documents(scan), pages("web", "page", 1), photos(scan), messages(scan)]
    if scan == 2:
        parts += [pages("mirror", "mirror", 4000000000001), ITEMS]
    start = "2024-01-01" if scan == 1 else "2025-01-01"
    return f"""facts{scan} AS (
      SELECT *, sha256(body) AS hash, {instant(start, 'ordinal * 7919')} AS observed_at
      FROM ({' UNION ALL '.join(parts)}))"""


TITLE = ("CASE WHEN kind = 'message' THEN name "
         "ELSE regexp_replace(name, '(.)\\.[^.]+$', '\\1') END")
FILE_ID = uid("'resource|file|' || hash")
MESSAGE_ID = uid("'resource|message|' || provider || '|' || external_id")

# The catalog after the first scan: the first file of a content creates its resource.
CATALOG = f"""{facts(1)},
    placed AS (
      SELECT *, CASE WHEN kind = 'message' THEN {MESSAGE_ID} ELSE {FILE_ID} END AS resource_id,
        kind = 'message' OR ordinal = min(ordinal) OVER (PARTITION BY kind, hash) AS creates
      FROM facts1),
    resources AS (
      SELECT resource_id AS id, kind AS resource_type, {TITLE} AS title,
        observed_at AS created_at FROM placed WHERE creates),
    blobs AS (
      SELECT {uid("'blob|' || resource_id || '|' || hash")} AS id, resource_id AS asset_id, hash,
        size, mime_type FROM placed WHERE creates),
    sources AS (
      SELECT {uid("'source|' || provider || '|' || external_id")} AS id,
        {uid("'blob|' || resource_id || '|' || hash")} AS blob_id, provider, external_id, path,
        name, CASE WHEN kind = 'message' THEN hash ELSE version_tag END AS version_tag,
        modified_at, meta, TRUE AS is_active FROM placed)"""

CATEGORY = ("CASE WHEN coalesce(mime_type, '') = '' THEN 'unknown' WHEN contains(mime_type, '/') "
            "THEN lower(split_part(mime_type, '/', 1)) ELSE 'other' END")
JOINED = """joined AS (
      SELECT r.id, r.resource_type, r.title, r.created_at, b.hash, b.size, b.mime_type,
        s.id AS source_id, s.provider, s.external_id, s.path, s.name, s.modified_at, s.meta
      FROM resources r JOIN blobs b ON b.asset_id = r.id JOIN sources s ON s.blob_id = b.id
      WHERE s.is_active)"""


def ref(expr: str) -> str:
    return f"'catalog:resource:' || {expr}"
