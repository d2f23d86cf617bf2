"""Independent DuckDB SQL for every exactly checkable query.

Written from the semantics, not from the Spark code: tokens come from a
regular-expression split over the separator class (Spark uses translate and
a literal split), counts from GROUP BY, windows from equi joins on shifted
positions, Huffman trees from two queues in a recursive query.
Tables are the pre-registered views named after the parquet files.
"""

from __future__ import annotations

import string

# The three separator sets as regular-expression classes.
SEPARATOR_CLASS = {
    "A": r"""[ \t\n.,()'":;!?<>]""",
    "B": r"""[ \t\n.,()'":;!?<>\[\]\-]""",
    "C": r"""[ \t\n.,()'":;!?<>\[\]\-=|]""",
}

UP = string.ascii_uppercase
LO = string.ascii_lowercase


def toks(preset: str, text: str = "text") -> str:
    """SQL list of tokens of ``text`` for a separator preset."""
    seps = SEPARATOR_CLASS[preset].replace("'", "''")
    return (f"list_filter(regexp_split_to_array(translate(coalesce({text}, ''), '{UP}', '{LO}'), "
            f"'{seps}'), lambda x: x <> '')")


def _rand32(key_sql: str) -> str:
    return f"CAST(('0x' || substr(md5({key_sql}), 1, 8)) AS BIGINT)"


def _tc(preset: str = "A", table: str = "documents", id_col: str = "doc_id",
        text_col: str = "text") -> str:
    """CTE body: (doc_id, term, cnt, total)."""
    return f"""
    SELECT doc_id, term, count(*)::BIGINT AS cnt, any_value(total)::BIGINT AS total
    FROM (SELECT {id_col} AS doc_id, len(w) AS total, unnest(w) AS term
          FROM (SELECT {id_col}, {toks(preset, text_col)} AS w FROM {table}))
    GROUP BY doc_id, term"""


def _vocab_ctes(min_count: int = 8, max_freq: float = 0.005, preset: str = "C") -> str:
    """CTEs: wc(word, count), tot(total), vocab(word, count), tree(word, count)."""
    return f"""
    tw AS (SELECT doc_id, {toks(preset)} AS w FROM documents),
    wc AS (SELECT word, count(*)::BIGINT AS count FROM (SELECT unnest(w) AS word FROM tw) GROUP BY word),
    tot AS (SELECT sum(len(w))::BIGINT AS total FROM tw),
    vocab AS (SELECT word, count FROM wc, tot
              WHERE count > {min_count} AND count < floor(total * {max_freq})),
    tree AS (SELECT word, count FROM vocab
             WHERE NOT (regexp_full_match(word, '[+-]?[0-9]+') AND octet_length(encode(word)) > 7))"""


def _pairs_cte(half: int = 4) -> str:
    """CTE: pairs(doc_id, pos, context_pos, word, context), known tokens only."""
    return f"""
    tp AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS pos FROM tw),
    kt AS (SELECT doc_id, pos, word FROM tp SEMI JOIN tree USING (word)),
    sh AS (SELECT doc_id, pos, word, pos + unnest({[d for d in range(-half, half + 1) if d]}) AS at FROM kt),
    pairs AS (SELECT sh.doc_id, sh.pos, kt.pos AS context_pos, sh.word, kt.word AS context
              FROM sh JOIN kt ON sh.doc_id = kt.doc_id AND sh.at = kt.pos)"""


def _huffman_ctes() -> str:
    """CTEs: codes(word, count, place, len, code), paths(word, depth, node, label).

    Two queues: leaves by ascending count, inner nodes as they are made; the
    smaller front is taken, a leaf if equal. Leaf i is node i, the inner node
    of step k is node n + k.
    """
    return """
    lv AS MATERIALIZED (SELECT list(count ORDER BY count) AS w, count(*)::INT AS n FROM tree),
    mg(step, i, j, made, a, b) AS (
      SELECT 0, 1, 1, []::BIGINT[], 0, 0
      UNION ALL
      SELECT step + 1, i2, j2, list_append(made, wa + wb), a2, b2 FROM (
        SELECT step, made, n, wa, a2,
               CASE WHEN leaf_b THEN i1 + 1 ELSE i1 END AS i2, CASE WHEN leaf_b THEN j1 ELSE j1 + 1 END AS j2,
               CASE WHEN leaf_b THEN w[i1] ELSE made[j1] END AS wb, CASE WHEN leaf_b THEN i1 ELSE n + j1 END AS b2
        FROM (SELECT *, i1 <= n AND (j1 > len(made) OR w[i1] <= made[j1]) AS leaf_b FROM (
          SELECT step, made, n, w, CASE WHEN leaf_a THEN w[i] ELSE made[j] END AS wa,
                 CASE WHEN leaf_a THEN i ELSE n + j END AS a2,
                 CASE WHEN leaf_a THEN i + 1 ELSE i END AS i1, CASE WHEN leaf_a THEN j ELSE j + 1 END AS j1
          FROM (SELECT mg.*, lv.w, lv.n, i <= n AND (j > len(made) OR w[i] <= made[j]) AS leaf_a
                FROM mg, lv WHERE step < n - 1))))),
    edge AS (SELECT (SELECT n FROM lv) + step AS parent, unnest([a, b]) AS child FROM mg WHERE step > 0),
    dp(node, depth) AS (
      SELECT 2 * n - 1, 0 FROM lv
      UNION ALL
      SELECT edge.child, depth + 1 FROM dp JOIN edge ON edge.parent = dp.node),
    ls AS (SELECT depth AS len, row_number() OVER (ORDER BY depth) - 1 AS place FROM dp, lv WHERE node <= n),
    lc AS (SELECT len, count(*) AS c, min(place) AS first_place FROM ls GROUP BY len),
    fc AS (SELECT x.len, x.first_place, coalesce(sum(y.c * (1::BIGINT << (x.len - y.len))), 0) AS first_code
           FROM lc x LEFT JOIN lc y ON y.len < x.len GROUP BY x.len, x.first_place),
    codes AS (SELECT word, count, t.place::BIGINT AS place, ls.len::INT AS len,
                     (first_code + t.place - first_place)::BIGINT AS code
              FROM (SELECT word, count, row_number() OVER (ORDER BY count DESC, word) - 1 AS place FROM tree) t
              JOIN ls ON ls.place = t.place JOIN fc ON fc.len = ls.len),
    paths AS (SELECT word, k::INT AS depth, ((1::BIGINT << k) + (code >> (len - k)))::BIGINT AS node,
                     (1 - ((code >> (len - 1 - k)) & 1))::INT AS label
              FROM (SELECT *, unnest(range(0, len)) AS k FROM codes))"""


def _targets_cte() -> str:
    """CTE: targets(word, node, n, n1); after the pairs and Huffman CTEs."""
    return """
    co AS (SELECT word, context, count(*) AS n FROM pairs GROUP BY word, context),
    targets AS (SELECT co.word, node, sum(n)::BIGINT AS n, sum(n * label)::BIGINT AS n1
                FROM co JOIN paths ON paths.word = co.context GROUP BY co.word, node)"""


def _random_vector(key_sql: str, dim: int = 100) -> str:
    key = f"{key_sql} || ':' || CAST(i AS VARCHAR) || ':0'"
    return f"list_transform(range({dim}), lambda i: {_rand32(key)}::DOUBLE / 4294967296.0::DOUBLE - 0.5::DOUBLE)"


def _gradient_ctes() -> str:
    """CTEs: wp(word, vec), np(node, vec), gw(word, i, g, n), gn(node, i, g, n)."""
    return f"""
    wp AS MATERIALIZED (SELECT word, {_random_vector('word')} AS vec FROM tree),
    np AS MATERIALIZED (SELECT node, {_random_vector("'node ' || CAST(node AS VARCHAR)")} AS vec FROM (SELECT DISTINCT node FROM paths)),
    er AS MATERIALIZED (SELECT word, node, n, wp.vec AS wv, np.vec AS nv,
             n1 - n * (CASE WHEN x <= -6 THEN 0.0 WHEN x >= 6 THEN 1.0 ELSE 1.0 / (1.0 + exp(-x)) END) AS err
           FROM (SELECT word, node, n, n1, list_dot_product(wp.vec, np.vec) AS x
                 FROM targets JOIN wp USING (word) JOIN np USING (node)) JOIN wp USING (word) JOIN np USING (node)),
    gw AS (SELECT word, i, sum(err * v) AS g, sum(n)::BIGINT AS n
           FROM (SELECT word, err, n, unnest(nv) AS v, generate_subscripts(nv, 1) AS i FROM er) GROUP BY word, i),
    gn AS (SELECT node, i, sum(err * v) AS g, sum(n)::BIGINT AS n
           FROM (SELECT node, err, n, unnest(wv) AS v, generate_subscripts(wv, 1) AS i FROM er) GROUP BY node, i)"""


def _emb(alias: str = "e") -> str:
    return f"CAST({alias}.embedding AS DOUBLE[])"


def _dot(a: str, b: str) -> str:
    return f"list_dot_product({a}, {b})"


def _cos(a: str, b: str) -> str:
    return (f"CASE WHEN sqrt(list_dot_product({a},{a})) * sqrt(list_dot_product({b},{b})) = 0 "
            f"THEN NULL ELSE list_dot_product({a},{b}) / "
            f"(sqrt(list_dot_product({a},{a})) * sqrt(list_dot_product({b},{b}))) END")


QUERY_VECTORS = """
    qv AS (SELECT label AS query_id, arg_min(vec_id, vec_id) AS qid FROM embeddings GROUP BY label),
    q AS (SELECT qv.query_id, qv.qid, CAST(e.embedding AS DOUBLE[]) AS qvec
          FROM qv JOIN embeddings e ON e.vec_id = qv.qid)"""


def sql() -> dict[str, str]:
    tc_a = _tc("A")
    q: dict[str, str] = {}

    q["corpus_scan"] = "SELECT doc_id, coalesce(text, '') AS text FROM documents"

    q["json_corpus"] = """
    SELECT event_id, json_extract_string(props, '$.k') AS doc_id,
           coalesce(json_extract_string(props, '$.content'), '') AS text,
           CAST(NULL AS VARCHAR) AS corrupt
    FROM events"""

    q["json_documents"] = """
    SELECT CAST(doc_id AS VARCHAR) AS doc_id, coalesce(text, '') AS text, CAST(NULL AS VARCHAR) AS corrupt
    FROM documents"""

    q["chunk_documents"] = """
    SELECT doc_id, i::BIGINT AS chunk, substr(text, i * 1000 + 1, 1000) AS text
    FROM (SELECT doc_id, coalesce(text, '') AS text,
                 unnest(range(0, CAST(ceil(length(coalesce(text, '')) / 1000.0) AS BIGINT))) AS i
          FROM documents)"""

    for p in "ABC":
        q[f"tokenize_{p.lower()}"] = f"""
        SELECT doc_id, {toks(p)} AS words FROM documents"""

    q["token_positions"] = f"""
    SELECT doc_id, (generate_subscripts(w, 1) - 1)::BIGINT AS pos, unnest(w) AS word
    FROM (SELECT doc_id, {toks('C')} AS w FROM documents)"""

    q["empty_documents"] = f"""
    SELECT count(*)::BIGINT AS n_docs,
           count(*) FILTER (WHERE len(w) = 0)::BIGINT AS n_empty,
           count(*) FILTER (WHERE len(w) > 0)::BIGINT AS n_nonempty
    FROM (SELECT {toks('A')} AS w FROM documents)"""

    q["term_counts"] = f"SELECT doc_id, term, cnt FROM ({tc_a})"

    q["doc_lengths"] = f"SELECT doc_id, len({toks('A')})::BIGINT AS total FROM documents"

    q["doc_terms"] = f"SELECT doc_id, list_sort(list_distinct({toks('A')})) AS terms FROM documents"

    q["tf"] = f"SELECT doc_id, term, cnt, total, cnt::DOUBLE / total AS tf FROM ({tc_a})"

    q["doc_count"] = "SELECT count(*)::BIGINT AS n_docs FROM documents"

    q["document_frequency"] = f"SELECT term, count(*)::BIGINT AS df FROM ({tc_a}) GROUP BY term"

    q["idf"] = f"""
    SELECT term, df, CAST(ln(n.n_docs::DOUBLE / df) AS FLOAT) AS idf
    FROM (SELECT term, count(*)::BIGINT AS df FROM ({tc_a}) GROUP BY term),
         (SELECT count(*) AS n_docs FROM documents) n"""

    q["postings"] = f"""
    SELECT term, doc_id, pos FROM (
      SELECT doc_id, (generate_subscripts(t, 1) - 1)::BIGINT AS pos, unnest(t) AS term
      FROM (SELECT doc_id, list_sort(list_distinct({toks('A')})) AS t FROM documents))"""

    q["posting_lists"] = q["postings"]
    q["written_postings"] = f"""SELECT * FROM ({q['postings']}) WHERE term >= 'm' AND term < 'n'"""
    q["posting_blocks"] = f"""
    WITH p AS ({q['postings']}),
    g AS (SELECT *, doc_id // 128 AS block, doc_id - lag(doc_id, 1, doc_id) OVER (PARTITION BY term, doc_id // 128 ORDER BY doc_id) AS gap FROM p)
    SELECT term, block::BIGINT AS block, min(doc_id) AS first_doc, list(gap::BIGINT ORDER BY doc_id) AS gaps,
           list(pos ORDER BY doc_id) AS positions
    FROM g GROUP BY term, block"""

    # Characters at their byte offsets; a chunk has those that begin in it.
    q["file_chunks"] = """
    WITH f AS (SELECT doc_id // 100 AS file, string_agg(coalesce(text, '') || chr(10), '' ORDER BY doc_id) AS whole FROM documents GROUP BY file),
    c AS (SELECT file, generate_subscripts(s, 1) AS i, unnest(s) AS ch FROM (SELECT file, string_split(whole, '') AS s FROM f)),
    o AS (SELECT file, i, ch, coalesce(sum(strlen(ch)) OVER (PARTITION BY file ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM c)
    SELECT file::BIGINT AS file, (start // 4096)::BIGINT AS chunk, string_agg(ch, '' ORDER BY i) AS text FROM o GROUP BY file, start // 4096"""

    q["tfidf"] = f"""
    WITH tc AS ({tc_a}),
    dfq AS (SELECT term, count(*)::BIGINT AS df FROM tc GROUP BY term),
    n AS (SELECT count(*) AS n_docs FROM documents)
    SELECT tc.doc_id, tc.term, tc.cnt, tc.total, tc.cnt::DOUBLE / tc.total AS tf, dfq.df,
           CAST(ln(n.n_docs::DOUBLE / dfq.df) AS FLOAT) AS idf,
           (tc.cnt::DOUBLE / tc.total) * CAST(CAST(ln(n.n_docs::DOUBLE / dfq.df) AS FLOAT) AS DOUBLE) AS tf_idf
    FROM tc JOIN dfq USING (term) CROSS JOIN n"""

    q["tfidf_vectors"] = f"""
    WITH tc AS ({tc_a}),
    dfq AS (SELECT term, count(*)::BIGINT AS df FROM tc GROUP BY term),
    n AS (SELECT count(*) AS n_docs FROM documents),
    t AS (SELECT tc.doc_id, tc.term, tc.cnt::DOUBLE / tc.total AS tf,
                 (tc.cnt::DOUBLE / tc.total) * CAST(CAST(ln(n.n_docs::DOUBLE / dfq.df) AS FLOAT) AS DOUBLE) AS tf_idf
          FROM tc JOIN dfq USING (term) CROSS JOIN n),
    v AS (SELECT doc_id, list(term ORDER BY term) AS terms, list(tf ORDER BY term) AS tf,
                 list(tf_idf ORDER BY term) AS tf_idf FROM t GROUP BY doc_id)
    SELECT d.doc_id, coalesce(v.terms, []::VARCHAR[]) AS terms, coalesce(v.tf, []::DOUBLE[]) AS tf,
           coalesce(v.tf_idf, []::DOUBLE[]) AS tf_idf
    FROM documents d LEFT JOIN v USING (doc_id)"""

    v = _vocab_ctes()
    q["word_counts"] = f"WITH {v} SELECT word, count FROM wc"
    q["total_words"] = f"WITH {v} SELECT coalesce(total, 0)::BIGINT AS total_words FROM tot"
    q["vocabulary"] = f"WITH {v} SELECT word, count FROM vocab"
    q["integer_tokens"] = f"""WITH {v}
    SELECT word, count, octet_length(encode(word))::BIGINT AS n_bytes,
           octet_length(encode(word)) > 7 AS dropped
    FROM vocab WHERE regexp_full_match(word, '[+-]?[0-9]+')"""
    q["overfrequent_words"] = f"""WITH {v}
    SELECT word, count FROM wc, tot WHERE count > floor(total * 0.005)"""
    vb = _vocab_ctes(preset="B")
    q["vocabulary_b"] = f"WITH {vb} SELECT word, count FROM vocab"
    q["overfrequent_words_b"] = f"""WITH {vb}
    SELECT word, count FROM wc, tot WHERE count > floor(total * 0.005)"""
    q["frequent_words"] = f"WITH {v} SELECT word FROM wc, tot WHERE count > total * 0.005"
    q["vocab_lookup"] = f"""WITH {v},
    bw AS (SELECT DISTINCT unnest({toks('C')}) AS word FROM benchmark)
    SELECT bw.word, tree.count FROM bw LEFT JOIN tree USING (word)"""
    q["top_words"] = f"""WITH {v}
    SELECT word, count FROM tree ORDER BY count DESC, word LIMIT 100"""
    q["count_histogram"] = f"""WITH {v}
    SELECT count, count(*)::BIGINT AS n_words FROM tree GROUP BY count"""
    q["encode_tokens"] = f"""WITH {v},
    tp AS (SELECT doc_id, unnest(w) AS word, (generate_subscripts(w, 1) - 1)::BIGINT AS pos FROM tw)
    SELECT tp.doc_id, tp.pos, tp.word, tree.word IS NOT NULL AS known
    FROM tp LEFT JOIN tree USING (word)"""
    q["oov_rate"] = f"""WITH {v},
    tp AS (SELECT unnest(w) AS word FROM tw)
    SELECT count(*)::BIGINT AS n_tokens, count(tree.word)::BIGINT AS n_known,
           (count(*) - count(tree.word))::BIGINT AS n_oov
    FROM tp LEFT JOIN tree USING (word)"""
    q["skipgram_pairs"] = f"""WITH {v}, {_pairs_cte()}
    SELECT doc_id, pos::BIGINT AS pos, context_pos::BIGINT AS context_pos, word, context FROM pairs"""
    q["skipgram_windows"] = f"""WITH {v}, {_pairs_cte()}
    SELECT doc_id, pos::BIGINT AS pos, word, list(context_pos::BIGINT ORDER BY context_pos) AS context_pos,
           list(context ORDER BY context_pos) AS context
    FROM pairs GROUP BY doc_id, pos, word"""
    q["cooccurrence"] = f"""WITH {v}, {_pairs_cte()}
    SELECT word, context, count(*)::BIGINT AS n FROM pairs GROUP BY word, context"""

    # Optimal code cost by repeatedly merging the two smallest weights.
    q["huffman_summary"] = f"""WITH RECURSIVE {v},
    h(w, cost) AS (
      SELECT list_sort(list(count)), 0::BIGINT FROM tree
      UNION ALL
      SELECT list_concat(list_filter(w[3:], lambda x: x < w[1] + w[2]), [w[1] + w[2]],
                         list_filter(w[3:], lambda x: x >= w[1] + w[2])),
             cost + w[1] + w[2]
      FROM h WHERE len(w) > 1)
    SELECT (SELECT count(*) FROM tree)::BIGINT AS n_words,
           (SELECT count(*) - 1 FROM tree)::BIGINT AS n_internal,
           1.0::DOUBLE AS kraft_sum,
           (SELECT count(*) - 1 FROM tree)::BIGINT AS n_both_labels,
           max(cost)::BIGINT AS weighted_length
    FROM h"""

    q["init_params"] = f"""WITH {v}
    SELECT word, list_transform(range(100), lambda i:
        (CAST(('0x' || substr(md5(word || ':' || CAST(i AS VARCHAR) || ':0'), 1, 8)) AS BIGINT)::DOUBLE
         / 4294967296.0::DOUBLE - 0.5::DOUBLE) / 100.0::DOUBLE) AS vec
    FROM tree"""
    hc = _huffman_ctes()
    q["huffman_codes"] = f"WITH RECURSIVE {v}, {hc} SELECT word, count, place, len, code FROM codes"
    q["huffman_paths"] = f"WITH RECURSIVE {v}, {hc} SELECT word, depth, node, label FROM paths"
    tg = f"WITH RECURSIVE {v}, {_pairs_cte()}, {hc}, {_targets_cte()}"
    q["node_targets"] = f"{tg} SELECT word, node, n, n1 FROM targets"
    q["hs_gradient"] = f"""{tg}, {_gradient_ctes()}
    SELECT 'word' AS kind, word, CAST(NULL AS BIGINT) AS node, list(round(g, 4) + 0.0 ORDER BY i) AS grad, max(n) AS n FROM gw GROUP BY word
    UNION ALL
    SELECT 'node', NULL, node, list(round(g, 4) + 0.0 ORDER BY i), max(n) FROM gn GROUP BY node"""
    # the first step of AdaGrad: the sign of each component times the rate
    q["sync_step"] = f"""{tg}, {_gradient_ctes()}
    SELECT 'word' AS kind, word, CAST(NULL AS BIGINT) AS node, list(round(wp.vec[i] + 0.025 * g / sqrt(g * g), 6) + 0.0 ORDER BY i) AS vec
    FROM gw JOIN wp USING (word) GROUP BY word
    UNION ALL
    SELECT 'node', NULL, node, list(round(np.vec[i] + 0.025 * g / sqrt(g * g), 6) + 0.0 ORDER BY i) FROM gn JOIN np USING (node) GROUP BY node"""
    q["root_targets"] = f"""WITH {v}, {_pairs_cte()}
    SELECT word, count(*)::BIGINT AS n FROM pairs GROUP BY word"""
    q["minibatch_sizes"] = f"""
    SELECT {_rand32("CAST(doc_id AS VARCHAR) || ':0'")} % 4 AS batch, count(*)::BIGINT AS n_docs,
           sum(len({toks('C')}))::BIGINT AS n_tokens
    FROM documents GROUP BY batch"""

    e1, e2 = "CAST(e1.embedding AS DOUBLE[])", "CAST(e2.embedding AS DOUBLE[])"
    q["cosine_pairs"] = f"""
    SELECT e1.vec_id AS a, e2.vec_id AS b, round({_cos(e1, e2)}, 6) AS cos
    FROM embeddings e1 JOIN embeddings e2 ON e2.vec_id = e1.vec_id + 1"""
    d = _dot(e1, e2)
    q["score_pairs"] = f"""
    SELECT a, b, round(dot, 6) AS dot,
           round(CASE WHEN 20.0 * dot <= -6 THEN 0.0 WHEN 20.0 * dot >= 6 THEN 1.0
                      ELSE 1.0 / (1.0 + exp(-(20.0 * dot))) END, 6) AS score
    FROM (SELECT e1.vec_id AS a, e2.vec_id AS b, {d} AS dot
          FROM embeddings e1 JOIN embeddings e2 ON e2.vec_id = e1.vec_id + 1)"""
    ev = "CAST(e.embedding AS DOUBLE[])"
    q["nearest"] = f"""WITH {QUERY_VECTORS},
    s AS (SELECT q.query_id, e.vec_id AS id, {_cos(ev, 'q.qvec')} AS sim FROM q, embeddings e),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC NULLS LAST, id) AS rank FROM s)
    SELECT query_id, rank::BIGINT AS rank, id, round(sim, 6) AS sim FROM r WHERE rank <= 10"""
    q["farthest"] = f"""WITH {QUERY_VECTORS},
    s AS (SELECT q.query_id, e.vec_id AS id, {_cos(ev, 'q.qvec')} AS sim FROM q, embeddings e),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim, id) AS rk FROM s WHERE sim IS NOT NULL)
    SELECT query_id, id, round(sim, 6) AS sim FROM r WHERE rk = 1"""
    twentieth = "q AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS qvec FROM embeddings WHERE vec_id % 20 = 0)"
    for name in ("nearest", "farthest"):
        q[f"{name}_twentieth"] = q[name].replace(QUERY_VECTORS, twentieth)
    q["analogy"] = f"""WITH
    r3 AS (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS r FROM embeddings),
    t AS (SELECT label AS query_id, max(vec_id) FILTER (WHERE r = 1) AS a, max(vec_id) FILTER (WHERE r = 2) AS b,
                 max(vec_id) FILTER (WHERE r = 3) AS c FROM r3 WHERE r <= 3 GROUP BY label HAVING count(*) = 3),
    tv AS (SELECT t.*, list_transform(list_zip(CAST(ea.embedding AS DOUBLE[]), CAST(eb.embedding AS DOUBLE[]),
                                                CAST(ec.embedding AS DOUBLE[])),
                                       lambda z: z[1] - z[2] + z[3]) AS qvec
           FROM t JOIN embeddings ea ON ea.vec_id = t.a JOIN embeddings eb ON eb.vec_id = t.b
                  JOIN embeddings ec ON ec.vec_id = t.c),
    s AS (SELECT tv.query_id, e.vec_id AS id, {_cos(ev, 'tv.qvec')} AS sim
          FROM tv, embeddings e WHERE e.vec_id NOT IN (tv.a, tv.b, tv.c)),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC NULLS LAST, id) AS rank FROM s)
    SELECT query_id, rank::BIGINT AS rank, id, round(sim, 6) AS sim FROM r WHERE rank <= 5"""
    q["vector_lookup"] = """
    WITH ids AS (SELECT DISTINCT label::BIGINT AS id FROM embeddings UNION SELECT max(vec_id) + 1 FROM embeddings)
    SELECT ids.id, CAST(embedding AS DOUBLE[]) AS vec FROM ids LEFT JOIN embeddings ON vec_id = ids.id"""
    q["vector_components"] = """
    SELECT vec_id AS id, CAST(embedding AS DOUBLE[])[1:5] AS comps FROM embeddings"""
    q["vector_mean_by_label"] = """
    SELECT label, n, list(s ORDER BY i) AS vec_sum, list(m ORDER BY i) AS vec_mean FROM (
      SELECT label, i, count(*)::BIGINT AS n, round(sum(x), 6) AS s, round(avg(x), 6) AS m
      FROM (SELECT label, unnest(CAST(embedding AS DOUBLE[])) AS x, generate_subscripts(embedding, 1) AS i
            FROM embeddings) GROUP BY label, i) GROUP BY label, n"""
    q["average_replicas"] = f"""WITH {QUERY_VECTORS},
    s AS (SELECT label, i, sum(x) AS sx FROM (
            SELECT label, unnest(CAST(embedding AS DOUBLE[])) AS x, generate_subscripts(embedding, 1) AS i
            FROM embeddings) GROUP BY label, i)
    SELECT q.query_id AS id, list(round(q.qvec[s.i] + s.sx / 8, 6) ORDER BY s.i) AS vec
    FROM q JOIN s ON s.label = q.query_id GROUP BY q.query_id"""
    return q
