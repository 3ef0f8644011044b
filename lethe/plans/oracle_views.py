"""DuckDB twins of ``lethe.plans.views`` as CTE bodies."""

PAD = "lpad(CAST({c} AS VARCHAR), CAST(greatest(3, length(CAST({c} AS VARCHAR))) AS INTEGER), '0')"

VIEWS = {
    "v_qa": f"""
SELECT {PAD.format(c='conv_id')} AS id, conv_id, turn, text AS question, nt AS answer
FROM (SELECT conv_id, turn, role, text,
             lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS nr,
             lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS nt
      FROM conversations) t
WHERE role = 'user' AND nr = 'assistant'""",
    "v_ids": f"SELECT DISTINCT {PAD.format(c='conv_id')} AS id FROM conversations",
    "v_customer_ids": f"""
SELECT CASE WHEN c_custkey % 50 = 3 THEN NULL WHEN c_custkey % 20 = 7 THEN {PAD.format(c='(c_custkey - 1)')}
            ELSE {PAD.format(c='c_custkey')} END AS id FROM customer""",
    "v_mcq": """
SELECT id, turn, kind, Question, Options, Correct_Answer, generated_text,
       CAST(row_number() OVER (PARTITION BY id, kind ORDER BY turn) AS INTEGER) AS question_idx
FROM (
  SELECT id, turn,
    CASE WHEN turn % 4 = 0 THEN 'Image_Textual' ELSE 'Pure_Text' END AS kind,
    question AS Question,
    CASE WHEN turn % 6 = 2
      THEN MAP(['A','B','C'], [coalesce(w[1],''), coalesce(w[2],''), coalesce(w[3],'')])
      ELSE MAP(['A','B','C','D'], [coalesce(w[1],''), coalesce(w[2],''), coalesce(w[3],''), coalesce(w[4],'')])
    END AS Options,
    substr('ABCD', ascii(substr(md5(id || ':' || CAST(turn AS VARCHAR)), 1, 1)) % 4 + 1, 1) AS Correct_Answer,
    CASE ascii(substr(md5(id || ':' || CAST(turn AS VARCHAR) || ':gen'), 2, 1)) % 3
      WHEN 0 THEN 'USER: ' || question || chr(10) || 'ASSISTANT: ' || lt || ') because'
      WHEN 1 THEN '### Answer: ' || lower(lt)
      ELSE '  ' || lt || chr(10) END AS generated_text
  FROM (SELECT *, string_split(answer, ' ') AS w,
               substr('ABCDE', ascii(substr(md5(id || ':' || CAST(turn AS VARCHAR) || ':gen'), 1, 1)) % 5 + 1, 1) AS lt
        FROM v_qa) q) m""",
    "v_gen": """
SELECT id, turn, CASE WHEN turn % 4 = 0 THEN 'Image_Textual' ELSE 'Pure_Text' END AS Type,
       question AS Question, answer AS Ground_Truth,
       CASE WHEN turn % 3 = 0 THEN 'USER: <image>' || chr(10) || 'Who?' || chr(10) || 'ASSISTANT: ' || question
            ELSE question END AS generated_text
FROM v_qa""",
    "v_steps": """
SELECT CASE WHEN k % 40 <> 9 THEN run END AS run, CASE WHEN k % 60 <> 11 THEN epoch END AS epoch, "set",
       CASE WHEN k % 30 <> 4 THEN CASE run WHEN 'r2' THEN k - k % 50 WHEN 'r3' THEN k * 1000003 ELSE k END END AS step,
       CASE WHEN run = 'r1' AND k % 101 = 5 THEN CAST('NaN' AS DOUBLE)
            WHEN run = 'r2' AND k % 101 = 5 THEN CAST(CASE WHEN k % 2 = 0 THEN 'Infinity' ELSE '-Infinity' END AS DOUBLE)
            WHEN run = 'r3' AND k % 101 = 5 THEN CAST(1180591620717411303424 AS DOUBLE)
            ELSE CAST(value AS DOUBLE) END AS loss,
       [1, 2, 4][CAST(k % 3 + 1 AS INTEGER)] AS accum
FROM (SELECT CASE WHEN event_id % 10 < 7 THEN 'r0' ELSE 'r' || CAST(event_id % 10 - 6 AS VARCHAR) END AS run,
             CAST(ascii(event_type) - 96 AS INTEGER) AS epoch,
             CASE WHEN user_id % 15 <> 7 THEN CASE WHEN user_id % 2 = 0 THEN 'forget' ELSE 'retain' END END AS "set",
             event_id AS k, value
      FROM events) e""",
    "v_profile_el": f"""
SELECT x.id AS ID, x.conv_id,
       CASE WHEN x.conv_id % 3 = 0 THEN x.id || '.png' ELSE '/data/images/' || x.id || '.png' END AS Directory,
       pos, eID, Question, Answer, Additional_ID, Additional_question, Additional_answer
FROM (
  SELECT id, conv_id, CAST(row_number() OVER (PARTITION BY id ORDER BY turn) AS INTEGER) AS pos,
         id || '_' || CAST(turn AS VARCHAR) AS eID,
         CASE WHEN (conv_id + turn) % 11 = 0 THEN NULL ELSE question END AS Question,
         CASE WHEN (conv_id + turn) % 9 = 0 THEN '' ELSE answer END AS Answer,
         CAST(NULL AS VARCHAR) AS Additional_ID, CAST(NULL AS VARCHAR) AS Additional_question,
         CAST(NULL AS VARCHAR) AS Additional_answer
  FROM v_qa
  UNION ALL
  SELECT id, conv_id, CAST(count(*) + 1 AS INTEGER), NULL, NULL, NULL, id,
         'Who is person ' || id || '?', 'first note on ' || id
  FROM v_qa WHERE conv_id % 2 = 0 GROUP BY id, conv_id
  UNION ALL
  SELECT id, conv_id, CAST(count(*) + 2 AS INTEGER), NULL, NULL, NULL, id,
         'Who is person ' || id || '?', 'second note on ' || id
  FROM v_qa WHERE conv_id % 6 = 0 GROUP BY id, conv_id) x""",
    "v_person": f"""
SELECT {PAD.format(c='c_custkey')} AS ID,
       CASE WHEN c_custkey % 13 = 0 THEN NULL WHEN c_custkey % 3 = 1 THEN p_name || ' ' || CAST(c_custkey AS VARCHAR)
            ELSE p_name END AS Name,
       CASE WHEN c_custkey % 17 = 0 THEN NULL ELSE c_mktsegment END AS Employment,
       n_name AS Born, 'What does ' || c_name || ' do?' AS question,
       c_name || ' works in ' || c_mktsegment AS answer
FROM customer LEFT JOIN part ON p_partkey = c_custkey LEFT JOIN nation ON n_nationkey = c_nationkey""",
    "v_images": f"""
SELECT DISTINCT path, length FROM (
  SELECT '/data/images/' || {PAD.format(c='k')} || ['.png', '.jpg', '.jpeg'][CAST(k % 3 + 1 AS INTEGER)] AS path,
         k * 100 + 7 AS length
  FROM (SELECT DISTINCT doc_id AS k FROM labels) e
  UNION ALL
  SELECT '/data/images/' || {PAD.format(c='k')} || '.jpg', k * 100 + 7
  FROM (SELECT DISTINCT doc_id AS k FROM labels) e WHERE k % 4 = 0) t""",
    "v_loss": f"""
SELECT {PAD.format(c='d.doc_id')} AS example_id, CAST(floor(d.doc_id / 4) AS BIGINT) AS batch_id,
       CAST(d.n_chars AS DOUBLE) / 1000 AS current_loss,
       CAST(l.quality + 0.5 * l.toxic AS DOUBLE) AS oracle_loss
FROM documents d JOIN labels l ON l.doc_id = d.doc_id""",
    "v_logits": f"""
SELECT CAST(floor(e.vec_id / 4) AS BIGINT) AS batch_id, {PAD.format(c='e.vec_id')} AS example_id, 0 AS pos,
       CAST(e.embedding AS DOUBLE[]) AS logits, CAST(o.embedding AS DOUBLE[]) AS orig_logits
FROM embeddings e JOIN embeddings o ON o.vec_id = e.vec_id + 1""",
    "v_docs": f"""
SELECT doc_id, CASE WHEN doc_id % 50 = 7 THEN NULL WHEN doc_id % 20 = 9 THEN {PAD.format(c='(doc_id - 1)')}
                    ELSE {PAD.format(c='doc_id')} END AS example_id,
       CASE doc_id % 40 WHEN 3 THEN '' WHEN 21 THEN ' ' || chr(10) || ' ' ELSE text END AS text FROM documents""",
    "v_rows": f"""
SELECT CASE WHEN conv_id % 9 = 4 THEN NULL WHEN conv_id % 5 = 2 THEN {PAD.format(c='(conv_id - 1)')} ELSE id END AS id, turn
FROM v_qa""",
}

DEPS = {
    "v_mcq": ["v_qa"], "v_gen": ["v_qa"], "v_profile_el": ["v_qa"], "v_rows": ["v_qa"],
}


def with_views(*names: str) -> str:
    """``WITH`` clause defining the named views and their dependencies."""
    order: list[str] = []

    def add(n):
        for dep in DEPS.get(n, []):
            add(dep)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    return "WITH " + ",\n".join(f"{n} AS ({VIEWS[n]})" for n in order) + "\n"
