"""Registered queries of the training-data operators: every query applies one
operator to its whole table and derives the digest columns of its result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlab.llm import (conversation_repair, exact_dedup, html_extract, language_id, license_scan, line_dedup, mixing,
                         near_dedup, packing, pii, quality_rules, secret_scan, token_alignment)
from flowlab.llm.common import UPPER, piece_files, table, tokenizer_files


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_documents(table(spark, sf_dir, "documents"), **tokenizer_files())


def op2_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_extract.extract(table(spark, sf_dir, "pages"), keep=["url"])
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules.ledger(table(spark, sf_dir, "documents"))
    base = quality_rules.passes("base")
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                        (~base).alias("base_failed"), (base & quality_rules.passes("v2")).alias("kept"), "fail_bits")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.mix_plan(table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan(table(spark, sf_dir, "documents"))
    return found.withColumn("score", F.round("score", 9))


def _joined(spans):
    """kind:start:end of spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(table(spark, sf_dir, "documents"))

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["kind"].isin(secret_scan.BASE))
    return found.select("doc_id", *[count(k) for k in secret_scan.BASE],
                        F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.col("text_digest").alias("text_sha256"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup(table(spark, sf_dir, "documents"))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_dedup(table(spark, sf_dir, "documents"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language_id.predict(docs, language_id.fit(docs))
    return found.select("doc_id", F.coalesce(language_id.held_out("doc_id"), F.lit(False)).alias("held_out"),
                        "lang_pred", "score", "ambiguous")


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = token_alignment.scored_alignment(table(spark, sf_dir, "documents"), **tokenizer_files(), **piece_files())
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op12_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = pii.scan(docs, pii.fit(docs))
    base = F.filter("spans", lambda s: s["base"])

    def count(kind):
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *[count(k) for k in pii.KINDS], F.sha2(_joined(base), 256).alias("base_sha256"),
                        _joined(F.col("spans")).alias("spans"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return conversation_repair.repair_report(conversation_repair.damage(rows), rows)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline
    return corpus_pipeline.run(spark, sf_dir)


def queries():
    return {
        "op1_packing": op1_packing, "op2_html_extract": op2_html_extract, "op3_quality_rules": op3_quality_rules,
        "op4_mixing": op4_mixing, "op5_license_scan": op5_license_scan, "op6_secret_scan": op6_secret_scan,
        "op7_exact_dedup": op7_exact_dedup, "op8_line_dedup": op8_line_dedup, "op9_near_dedup": op9_near_dedup,
        "op10_language_id": op10_language_id, "op11_token_alignment": op11_token_alignment,
        "op12_pii": op12_pii, "op13_conversation_repair": op13_conversation_repair, "pipeline": pipeline,
    }


OP4_SQL = f"""
WITH rows AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM rows GROUP BY source),
w AS (
  SELECT source, source_size, 2 * source_size AS top,
         [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::BIGINT AS weight FROM s),
b AS (
  SELECT *, sum(source_size) OVER ()::BIGINT * 1.5::DOUBLE - coalesce(sum(top) OVER before, 0)::BIGINT AS remaining,
         sum(weight) OVER ()::BIGINT - coalesce(sum(weight) OVER before, 0)::BIGINT AS open_weight
  FROM w WINDOW before AS (ORDER BY top / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT *, max(CASE WHEN top / weight >= remaining / open_weight THEN remaining / open_weight END) OVER () AS level FROM b),
t AS (SELECT source, source_size, least(top::DOUBLE, weight * level) AS target FROM l),
r AS (
  SELECT *, floor(rate)::BIGINT AS whole, floor((rate - floor(rate)) * {mixing.DRAW})::BIGINT AS draw_below
  FROM (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate FROM t)),
h AS (
  SELECT doc_id, source, size, ('0x' || substr(m, 1, 8))::BIGINT AS a, ('0x' || substr(m, 9, 8))::BIGINT AS b
  FROM (SELECT *, md5('mix:' || coalesce(doc_id::VARCHAR, 'null')) AS m FROM rows)),
tried AS (
  SELECT h.source, k, sum(CASE WHEN (a + k * b) % {mixing.DRAW} < draw_below THEN size ELSE 0 END)::BIGINT AS got
  FROM h JOIN r ON h.source IS NOT DISTINCT FROM r.source CROSS JOIN range({mixing.SEEDS}) seeds(k) GROUP BY h.source, k),
best AS (
  SELECT source, k FROM (
    SELECT tried.source, k, row_number() OVER (PARTITION BY tried.source
             ORDER BY abs(whole * source_size + got - target), k) AS nth
    FROM tried JOIN r ON tried.source IS NOT DISTINCT FROM r.source) WHERE nth = 1)
SELECT doc_id, size, source_size, target,
       size * (whole + CASE WHEN (a + k * b) % {mixing.DRAW} < draw_below THEN 1 ELSE 0 END) AS taken
FROM h JOIN r ON h.source IS NOT DISTINCT FROM r.source JOIN best ON h.source IS NOT DISTINCT FROM best.source
"""

OP7_SQL = f"""
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}') AS norm FROM documents),
g AS (SELECT norm, max(doc_id) AS keep_id, count(*)::BIGINT AS group_size FROM t GROUP BY norm)
SELECT doc_id, keep_id, group_size,
       doc_id IS NOT DISTINCT FROM keep_id
         AND row_number() OVER (PARTITION BY t.norm, doc_id ORDER BY doc_id) = 1 AS kept,
       sha256(t.norm) AS text_sha256
FROM t JOIN g ON t.norm = g.norm
"""


def license_sql() -> str:
    """Every start of every template, from exploded words, with the same templates."""
    from flowlab.llm.license_scan import SHARE, TEMPLATES, postings
    listed = ", ".join(f"({t}, '{TEMPLATES[t].label}', {TEMPLATES[t].base}, '{w}', {i}, {m})"
                       for t, w, i, m in postings(TEMPLATES))
    return f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM documents),
listed(template, label, base, word, pos, mandatory) AS (VALUES {listed}),
hits AS (SELECT r, p, words[p + 1] AS word FROM (SELECT r, words, unnest(range(len(words))) AS p FROM docs)
         WHERE words[p + 1] IN (SELECT word FROM listed)),
df AS (SELECT word, count(DISTINCT r) AS n FROM hits GROUP BY word),
idx AS (SELECT listed.*, ln((1.0 + (SELECT count(*) FROM docs))::DOUBLE / (1.0 + coalesce(n, 0))) AS idf
        FROM listed LEFT JOIN df USING (word)),
whole AS (SELECT template, sum(idf) AS all_idf, sum(mandatory::INT) AS all_keys FROM idx GROUP BY template),
met AS (SELECT r, template, label, base, p - pos AS start, sum(idf) AS idf, sum(mandatory::INT) AS keys
        FROM hits JOIN idx USING (word) GROUP BY ALL),
good AS (SELECT *, CASE WHEN all_idf > 0 THEN least(idf / all_idf, 1.0) ELSE 1.0 END AS share
         FROM met JOIN whole USING (template) WHERE keys = all_keys),
per_row AS (
  SELECT r, sum(base::INT) AS n_base, min(start) FILTER (base) AS first_word, max(start) FILTER (base) AS last_word,
         string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels,
         string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score
  FROM good WHERE share >= {SHARE} GROUP BY r)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word,
       last_word::BIGINT AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
       round(coalesce(score, 0.0), 9) AS score
FROM docs LEFT JOIN per_row USING (r)"""


OP8_SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
lines AS (SELECT r, doc_id, text, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM docs),
solid AS (SELECT r, doc_id, text, trim(line, blank) AS l, i, row_number() OVER (PARTITION BY r ORDER BY i) AS k FROM lines,
          (SELECT ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) AS blank) WHERE trim(line, blank) <> ''),
w AS (SELECT a.r, a.doc_id, a.text, a.l AS l1, b.l AS l2, c.l AS l3, [a.i, b.i, c.i] AS covers
      FROM solid a JOIN solid b ON a.r = b.r AND b.k = a.k + 1 JOIN solid c ON a.r = c.r AND c.k = a.k + 2),
ranked AS (SELECT *, dense_rank() OVER (PARTITION BY l1, l2, l3 ORDER BY doc_id NULLS FIRST, text, covers[1]) AS nth FROM w),
gone AS (SELECT DISTINCT r, unnest(covers) AS i FROM ranked WHERE nth > 1),
kept AS (SELECT l.r, string_agg(line, chr(10) ORDER BY l.i) AS text, count(*) AS n FROM lines l ANTI JOIN gone g ON l.r = g.r AND l.i = g.i GROUP BY l.r)
SELECT d.doc_id, coalesce(k.text, '') AS text, len(string_split(d.text, chr(10)))::BIGINT AS n_lines,
       (len(string_split(d.text, chr(10))) - coalesce(k.n, 0))::BIGINT AS n_removed
FROM docs d LEFT JOIN kept k ON d.r = k.r
"""


def quality_sql() -> str:
    """The rule ledger, with the rules and the policies written out: bits 1 and
    2 are the base, version 2 asks for all eight."""
    bits = """CASE WHEN n_words < 10 THEN 1 ELSE 0 END
  + CASE WHEN 5 * n_repeat_words > n_words THEN 2 ELSE 0 END
  + CASE WHEN 10 * n_symbols > 3 * n_words THEN 4 ELSE 0 END
  + CASE WHEN 2 * n_dup_lines > n_lines THEN 8 ELSE 0 END
  + CASE WHEN 5 * n_upper > 2 * n_letters THEN 16 ELSE 0 END
  + CASE WHEN word_chars NOT BETWEEN 2 * n_words AND 15 * n_words THEN 32 ELSE 0 END
  + CASE WHEN 2 * n_letter_words < n_words THEN 64 ELSE 0 END
  + CASE WHEN 10 * n_marks > 3 * n_words THEN 128 ELSE 0 END"""
    base, used = 3, 255
    blank = r"[\x20\x09-\x0D]"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, regexp_replace(t, '{blank}', '', 'g') AS bare FROM d),
win AS (SELECT r, i, list_slice(ws, i + 1, i + 5) AS x FROM (SELECT r, ws, unnest(range(len(ws) - 4)) AS i FROM w WHERE len(ws) >= 5)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, x) AS n FROM win) WHERE n > 1),
rep AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + 5)) AS p FROM twice) GROUP BY r),
lines AS (SELECT r, count(*) AS n, count(DISTINCT l) AS own FROM (SELECT r, unnest(string_split(t, chr(10))) AS l FROM d)
          WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY r),
m AS (SELECT doc_id, len(ws)::BIGINT AS n_words, length(bare)::BIGINT AS word_chars,
        length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(lines.n - own, 0)::BIGINT AS n_dup_lines,
        coalesce(rep.n, 0)::BIGINT AS n_repeat_words, coalesce(lines.n, 0)::BIGINT AS n_lines,
        length(regexp_replace(t, '[^A-Za-z]', '', 'g'))::BIGINT AS n_letters,
        length(regexp_replace(t, '[^A-Z]', '', 'g'))::BIGINT AS n_upper,
        len(list_filter(ws, lambda x: regexp_matches(x, '[A-Za-z]|[^\x00-\x7F]')))::BIGINT AS n_letter_words,
        length(regexp_replace(t, '[^!?]', '', 'g'))::BIGINT AS n_marks
      FROM w LEFT JOIN rep USING (r) LEFT JOIN lines USING (r)),
b AS (SELECT *, ({bits})::BIGINT AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (fail_bits & {base}) <> 0 AS base_failed,
       (fail_bits & {base | used}) = 0 AS kept, fail_bits FROM b"""


OP9_SQL = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'),
                            '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, x FROM (
        SELECT doc_id, list_slice(ws, i + 1, i + 5) AS x FROM (SELECT doc_id, ws, unnest(range(len(ws) - 4)) AS i FROM d WHERE len(ws) >= 5)
        UNION ALL SELECT doc_id, ws FROM d WHERE len(ws) BETWEEN 1 AND 4)),
n AS (SELECT doc_id, count(*)::BIGINT AS n FROM s GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY 1, 2),
link AS MATERIALIZED (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
reach AS (SELECT a AS doc_id, b AS other FROM link UNION SELECT reach.doc_id, link.b FROM reach JOIN link ON reach.other = link.a),
least_of AS (SELECT doc_id, min(other) AS other FROM reach GROUP BY doc_id)
SELECT doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(doc_id, coalesce(other, doc_id)) AS component_id,
       doc_id = least(doc_id, coalesce(other, doc_id)) AS kept
FROM (SELECT doc_id FROM documents) LEFT JOIN n USING (doc_id) LEFT JOIN least_of USING (doc_id)
"""


def _edit(kind: str, state: int, cost: str) -> str:
    """An edit before the best rest from a state of the next row."""
    return f"{{'c': s[{state}].c + {cost}, 'a': '{kind}' || s[{state}].a}}"


def _due(initial: str, state: int) -> str:
    """Keep the role that is due or give it; null for blank and repeated rows."""
    return f"CASE WHEN fault IN ('b', 'd') THEN NULL WHEN r = '{initial}' THEN {_edit('K', state, 't')} ELSE {_edit('R', state, '2 + t')} END"


# states 1 to 4: nothing yet, after system, after user, after assistant; s holds the best (cost, audit) from each to the end
OP13_SQL = rf"""
WITH RECURSIVE convs AS (SELECT conv_id, row_number() OVER () AS cid FROM (SELECT DISTINCT conv_id FROM conversations)),
src AS (SELECT cid, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
          coalesce(c.conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k
        FROM conversations c JOIN convs ON c.conv_id IS NOT DISTINCT FROM convs.conv_id),
kinds AS (SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, len(k) + 1), lambda i: ord(k[i])::BIGINT)),
    lambda crc, b: list_reduce(list_prepend(xor(crc, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
      lambda v, z: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END)), 4294967295) % 20 AS kind FROM src),
damaged AS (SELECT cid, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy FROM kinds WHERE kind <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY cid ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS i FROM damaged),
f AS MATERIALIZED (SELECT *, left(role, 1) AS r, CASE WHEN NOT regexp_matches(text, '[^ 	-]') THEN 'b'
    WHEN row_number() OVER (PARTITION BY cid, role, text ORDER BY i) > 1 THEN 'd'
    WHEN NOT regexp_matches(text, '[.!?][ 	-]*\z') THEN 't' ELSE '' END AS fault FROM placed),
seen AS (SELECT cid, COUNT(*) AS n, coalesce(max(turn) - min(turn) + 1 - COUNT(DISTINCT turn), 0) AS gaps,
    COUNT(*) FILTER (WHERE fault = 'b') AS blank, COUNT(*) FILTER (WHERE fault = 'd') AS duplicate, COUNT(*) FILTER (WHERE fault = 't') AS truncated,
    COUNT(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM (SELECT *, lag(r) OVER (PARTITION BY cid ORDER BY i) || r AS pair FROM f) GROUP BY cid),
dp AS (
  SELECT cid, n AS i, [{{'c': 0::BIGINT, 'a': ''}}, {{'c': 4::BIGINT, 'a': 'II'}}, {{'c': 2::BIGINT, 'a': 'I'}}, {{'c': 0::BIGINT, 'a': ''}}] AS s FROM seen
  UNION ALL
  SELECT cid, i - 1, [list_min([s[1], {_edit('I', 3, '2')}, {_edit('II', 4, '4')}]), list_min([s[2], {_edit('I', 3, '2')}, {_edit('II', 4, '4')}]),
                      list_min([s[3], {_edit('I', 4, '2')}]), list_min([s[4], {_edit('I', 3, '2')}])]
  FROM (
    SELECT cid, i, [
      list_min([{_edit('D', 1, '3')}, {_due('u', 3)}, CASE WHEN r = 's' AND fault NOT IN ('b', 'd') THEN {_edit('K', 2, 't')} END]),
      list_min([{_edit('D', 2, '3')}, {_due('u', 3)}]), list_min([{_edit('D', 3, '3')}, {_due('a', 4)}]),
      list_min([{_edit('D', 4, '3')}, {_due('u', 3)}])] AS s
    FROM (SELECT dp.cid, dp.i, s, r, fault, (fault = 't')::BIGINT AS t FROM dp JOIN f ON f.cid = dp.cid AND f.i = dp.i))),
best AS (SELECT cid, s[1].c AS cost, s[1].a AS audit FROM dp WHERE i = 0),
edits AS (SELECT cid, audit[p] AS e, p, len(regexp_replace(audit[1:p], 'I', '', 'g')) AS i
          FROM (SELECT cid, audit, unnest(range(1, len(audit) + 1)) AS p FROM best)),
kept AS (SELECT edits.cid, e, r, role, text, row_number() OVER (PARTITION BY edits.cid ORDER BY p) AS o
         FROM edits LEFT JOIN f ON f.cid = edits.cid AND f.i = edits.i WHERE e <> 'D'),
turned AS (SELECT *, o + coalesce(max(CASE WHEN o = 1 AND e = 'K' AND r = 's' THEN 1 END) OVER (PARTITION BY cid), 0) AS slot FROM kept),
lines AS (SELECT cid, o, CASE WHEN e = 'K' THEN role WHEN slot % 2 = 1 THEN 'user' ELSE 'assistant' END || ':'
            || CASE WHEN e = 'I' THEN '' ELSE text END AS line FROM turned),
hashes AS (SELECT cid, sha256(string_agg(line, chr(10) ORDER BY o)) AS h FROM lines GROUP BY cid)
SELECT conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
       coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(cost, 0)::BIGINT AS cost,
       coalesce(audit, '') AS audit, coalesce(h, sha256('')) AS repaired_sha256
FROM convs LEFT JOIN seen USING (cid) LEFT JOIN best USING (cid) LEFT JOIN hashes USING (cid)"""


def oracle_sql():
    """Where SQL can say it; the others are held against brute force in tests/llm."""
    return {"op3_quality_rules": quality_sql(), "op4_mixing": OP4_SQL, "op5_license_scan": license_sql(),
            "op7_exact_dedup": OP7_SQL, "op8_line_dedup": OP8_SQL, "op9_near_dedup": OP9_SQL,
            "op13_conversation_repair": OP13_SQL}
