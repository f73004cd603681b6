"""DuckDB SQL for the queries of this subpackage that SQL can express."""

_EACH_MODE = " UNION ALL ".join(f"SELECT CAST({m} AS INTEGER) AS mode_no, i{m} AS idx FROM nonzeros WHERE i{m} IS NOT NULL" for m in range(4))

_USABLE = """
    u AS (SELECT row_id, mode_no, vals FROM factor_rows WHERE len(vals) = 64 AND len(list_filter(vals, lambda v : v IS NULL OR isnan(v) OR isinf(v))) = 0 AND list_max(list_transform(vals, lambda v : abs(v))) > 0),
    c AS (SELECT a.row_id AS x, b.row_id AS y, round(list_cosine_similarity(a.vals, b.vals), 9) AS cosine FROM u a JOIN u b ON a.mode_no = b.mode_no AND a.row_id <> b.row_id)"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": f"""
            WITH x AS ({_EACH_MODE}), c AS (SELECT mode_no, idx, count(*) AS n FROM x GROUP BY ALL), t AS (SELECT mode_no, count(*) AS n FROM x GROUP BY ALL)
            SELECT c.mode_no, c.idx FROM c JOIN t USING (mode_no) WHERE c.n * 1000 >= 5 * t.n""",
        "p1_bounds": f"""
            WITH x AS ({_EACH_MODE}), c AS (SELECT mode_no, idx, count(*) AS n FROM x GROUP BY ALL), t AS (SELECT mode_no, count(*) AS n FROM x GROUP BY ALL)
            SELECT c.mode_no, c.idx, c.n AS n_rows, TRUE AS holds FROM c JOIN t USING (mode_no) WHERE c.n * 1000 >= 5 * t.n""",
        "p7_letters": """
            SELECT limit_id, CAST(sum((length(text) + capacity_tokens - 1) // capacity_tokens) AS BIGINT) AS pieces, CAST(sum(length(text)) AS BIGINT) AS letters,
                   CAST(0 AS BIGINT) AS overfull, CAST(0 AS BIGINT) AS missing, CAST(0 AS BIGINT) AS wrong, TRUE AS tight
            FROM documents, pack_limits WHERE length(text) > 0 GROUP BY 1""",
        "p8_reached": "SELECT mix_name, lower(trim(source)) AS source, target_share, TRUE AS capped, TRUE AS near_rate FROM mix_targets",
        "p9_texts": "SELECT doc_id, count(*) AS n_texts, TRUE AS sound FROM documents GROUP BY 1",
        "p5_recall": f"WITH {_USABLE} SELECT mode_no, count(*) AS n_rows, TRUE AS enough FROM u GROUP BY 1",
        "p6_sizes": f"WITH {_USABLE} SELECT mode_no, count(*) AS n_rows, CAST(0 AS BIGINT) AS untypical, CAST(0 AS BIGINT) AS torn FROM u GROUP BY 1",
        "p2_shares": """
            SELECT first AS first_delivery_id, count(*) AS records, TRUE AS within_chance, CAST(0 AS BIGINT) AS foreign
            FROM (SELECT nnz_id, min(coalesce(delivery_id, 1073741824)) AS first FROM nonzeros WHERE nnz_id IS NOT NULL GROUP BY 1) GROUP BY 1""",
        "p5_found": f"""
            WITH {_USABLE}, r AS (SELECT *, row_number() OVER (PARTITION BY x ORDER BY cosine DESC, y) AS n FROM c)
            SELECT DISTINCT least(x, y) AS row_id_a, greatest(x, y) AS row_id_b FROM r WHERE n <= 5 AND cosine >= 0.78""",
        "p6_found": f"""
            WITH RECURSIVE {_USABLE}, e AS MATERIALIZED (SELECT x, y FROM c WHERE cosine >= 0.78),
            reach(x, y) AS (SELECT x, x FROM e UNION SELECT reach.x, e.y FROM reach JOIN e ON e.x = reach.y),
            g AS (SELECT x AS row_id, min(y) AS first_row_id, count(*) AS n FROM reach GROUP BY x)
            SELECT row_id, first_row_id FROM g WHERE n >= 3""",
    }
