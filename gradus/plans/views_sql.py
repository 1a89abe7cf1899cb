"""The derived views as DuckDB SQL, for the oracle statements."""

from __future__ import annotations

from ..functions.formulas import TYPES
from ..sources.views import PREDICATES

_TYPES = ", ".join(f"'{t}'" for t in TYPES)
VIEWS = {
    "attempts": f"""select *, (n - 1) // 5 as session_no, user_id || '-' || concept_id || '-' || ((n - 1) // 5) as session_id,
      case when n <= 5 then 'diagnostic' when n <= 10 then 'practice' else 'mastery' end as mode
      from (select event_id as attempt_id, user_id, k % 5 as concept_id, 'q' || k as question_id, [{_TYPES}][(k // 5) % 5 + 1] as question_type,
        [1, 2, 3, 3, 4][(k // 5) % 5 + 1] as cognitive_level, k % 3 + 1 as difficulty, value < 60 as correct, ((event_id * 37 % 101) / 100.0)::double as confidence,
        floor(value)::int + 1 as time_taken, event_id % 10 = 9 as is_spaced, nullif(event_id % 4, 0) as hop, ts as created_at,
        row_number() over (partition by user_id, k % 5 order by ts, event_id) as n
        from (select event_id, ts, user_id, value, json_extract_string(props, '$.k')::int as k from events))""",
    "sessions": """select session_id, user_id, concept_id, session_no, mode, max(created_at) as created_at,
      coalesce(avg(case when not is_spaced then correct::int::double end), avg(correct::int::double)) * 100.0::double as score
      from attempts group by all""",
    "predicates": "select * from (values " + ", ".join(f"({i}, '{n}', {a}, {d})" for i, (n, a, d) in enumerate(PREDICATES)) + ") as t(idx, name, asym, dag)",
    "edges": """select doc * 20 + s as src, doc * 20 + d as dst, name as rel, born * 10000 + s * 500 + d * 25 + e.idx as edge_id, asym, dag
      from (select l_orderkey // 16 as doc, l_partkey % 20 as s, l_suppkey % 20 as d, (l_orderkey + l_linenumber * 7) % 25 as idx, min(l_orderkey * 8 + l_linenumber) as born from lineitem group by 1, 2, 3, 4) e join predicates p on p.idx = e.idx""",
    "linked_edges": "select case when src % 20 = 19 then src + 1 else src end as src, case when dst % 20 = 19 then dst + 1 else dst end as dst, rel, asym, dag, min(edge_id) as edge_id from edges group by all",
    "nodes": "select (doc * 20 + i)::bigint as node, 'Concept ' || (doc * 20 + i) as name, (doc % 3)::bigint as owner from (select distinct l_orderkey // 16 as doc from lineitem), range(20) as r(i)",
    "verifier_gold": "select doc_id, ['a', 'b', 'c'][doc_id % 3 + 1] as verdict, ((doc_id * 37 % 101) / 100.0)::double as confidence, quality = 1 as human, ['a', 'b', 'c'][(doc_id // 3) % 3 + 1] as human_verdict from labels",
    "chunks_fixed": """select doc_id, i::int as chunk_index, trim(substr(text, (i * 850 + 1)::bigint, 1000), ' ') as text from documents, unnest(range(greatest(0, ceil((length(text) - 1000) / 850.0))::bigint + 1)) as u(i)
      where length(trim(substr(text, (i * 850 + 1)::bigint, 1000), ' ')) >= 50""",
    "doc_pages": """select doc_id, i::int as page_number, substr(text, ((i - 1) * 1800 + 1)::bigint, 1800) as text, i % 4 = 0 as ocr_applied, case when i % 4 = 0 then ((doc_id * 37 + i) % 101)::double end as ocr_confidence
      from documents, unnest(range(1, greatest(1, ceil(length(text) / 1800.0))::bigint + 1)) as u(i)""",
    "consensus_runs": "select distinct l_orderkey // 16 as chunk, l_linenumber % 3 as run, l_partkey % 20 as item from lineitem",
    "raw_names": "select p_partkey, 0 as pos, 'The ' || p_name || ' system' as name from part union all select p_partkey, 1, p_name from part",
}
_NEEDS = {"sessions": ["attempts"], "edges": ["predicates"], "linked_edges": ["predicates", "edges"]}


def sql(body: str, *views: str, more: str = "") -> str:
    """A self-contained statement: the named views, further common tables, then the body."""
    order: list[str] = []
    for v in views:
        order += [x for x in (*_NEEDS.get(v, []), v) if x not in order]
    tables = [f"{v} as ({VIEWS[v]})" for v in order] + ([more] if more else [])
    return ("with recursive " + ",\n".join(tables) + "\n" if tables else "") + body


def r6(x: str, digits: int = 6) -> str:
    scale = f"1e{digits}::double"
    return f"(floor(({x}) * {scale} + 0.5::double) / {scale})"
