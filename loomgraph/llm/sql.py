"""The same results in SQL, where SQL can express them on whole tables."""

_KNOWN = """
members AS (
  SELECT DISTINCT uuid, embedding FROM entities WHERE uuid IS NOT NULL
), usable AS (
  SELECT uuid, CAST(embedding AS DOUBLE[]) AS v FROM members
  WHERE len(embedding) = 32 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), scored AS (
  SELECT DISTINCT least(uuid_a, uuid_b) AS a, greatest(uuid_a, uuid_b) AS b
  FROM entity_matches WHERE uuid_a <> uuid_b AND score >= 0.9 AND NOT isnan(score)
    AND uuid_a IN (SELECT uuid FROM members) AND uuid_b IN (SELECT uuid FROM members)
), judged AS (
  SELECT DISTINCT least(uuid_a, uuid_b) AS a, greatest(uuid_a, uuid_b) AS b
  FROM entity_matches m JOIN usable x ON x.uuid = m.uuid_a JOIN usable y ON y.uuid = m.uuid_b
  WHERE m.uuid_a <> m.uuid_b AND (m.score IS NULL OR isnan(m.score)) AND list_cosine_similarity(x.v, y.v) >= 0.9
), links AS (
  SELECT a, b FROM scored UNION SELECT a, b FROM judged
), ways AS (
  SELECT a AS s, b AS d FROM links UNION SELECT b, a FROM links
), reach(root, uuid) AS (
  SELECT s, s FROM ways UNION SELECT r.root, w.d FROM reach r JOIN ways w ON w.s = r.uuid
), grouped AS (
  SELECT min(root) AS group_uuid, uuid FROM reach GROUP BY uuid
)"""

_STAND_INS = (
    "'(novalue)', 'novalue', 'null', 'nil', 'none', 'n/a', 'na', 'n.a.', '-', '--', '—', '?', '??', 'unknown', '(unknown)', 'tbd', 'tba', "
    "'notavailable', 'notknown', 'notspecified', 'unspecified', 'undefined', 'missing', 'empty', '...', '…', 'nan', ''"
)

ORACLE = {
    "p1_found": f"WITH RECURSIVE {_KNOWN} SELECT group_uuid, uuid FROM grouped",
    "p2_found": f"""WITH RECURSIVE {_KNOWN}, records AS (
  SELECT DISTINCT uuid, created_at, name, description, entity_type FROM entities
), long AS (
  SELECT g.group_uuid, g.uuid, r.created_at, 'name' AS field, r.name AS value FROM grouped g JOIN records r USING (uuid)
  UNION ALL SELECT g.group_uuid, g.uuid, r.created_at, 'description', r.description FROM grouped g JOIN records r USING (uuid)
  UNION ALL SELECT g.group_uuid, g.uuid, r.created_at, 'entity_type', r.entity_type FROM grouped g JOIN records r USING (uuid)
), ranked AS (
  SELECT group_uuid, field, uuid, row_number() OVER (PARTITION BY group_uuid, field ORDER BY created_at DESC NULLS LAST, uuid) AS place
  FROM long WHERE value IS NOT NULL AND lower(regexp_replace(value, '[\\s\\x{{00A0}}\\x{{200B}}\\x{{FEFF}}]+', '', 'g')) NOT IN ({_STAND_INS})
) SELECT group_uuid, field, uuid FROM ranked WHERE place = 1""",
}
