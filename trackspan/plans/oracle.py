"""The same results as plain SQL, written independently of the operators, for DuckDB."""

from __future__ import annotations

import re

AS_OF = "DATE '2001-08-01'"

# Named relations; a query gets the ones it mentions, and theirs, as a WITH list.
RELATIONS = {
    "li": "SELECT l_orderkey, max(l_shipdate) AS last_ship, min(l_partkey) AS first_part FROM lineitem GROUP BY l_orderkey",
    "raw_tickets": """
SELECT n_name || '-' || o_orderkey AS key, n_name AS project,
  'Order ' || o_orderkey || ' for ' || c_mktsegment AS summary,
  CASE WHEN o_orderstatus <> 'P' THEN 'Raised for ' || c_mktsegment END AS description,
  CASE o_custkey % 4 WHEN 0 THEN 'Task' WHEN 1 THEN 'Bug' WHEN 2 THEN 'Story' ELSE 'Epic' END AS issue_type,
  CASE WHEN o_orderkey % 13 <> 0 THEN c_name END AS assignee,
  CASE WHEN o_orderkey % 13 <> 0 THEN accountId END AS assignee_id,
  CASE o_orderstatus
    WHEN 'F' THEN CASE o_orderkey % 4 WHEN 0 THEN 'Done' WHEN 1 THEN 'Closed' WHEN 2 THEN 'Resolved' ELSE 'Completed' END
    WHEN 'O' THEN CASE o_orderkey % 4 WHEN 0 THEN 'To Do' WHEN 1 THEN 'Open' WHEN 2 THEN 'New' ELSE 'Backlog' END
    ELSE CASE o_orderkey % 4 WHEN 0 THEN 'In Progress' WHEN 1 THEN 'Active' WHEN 2 THEN 'Development' ELSE 'Blocked' END END AS status,
  CASE o_orderpriority WHEN '1-URGENT' THEN CASE WHEN o_orderkey % 5 = 0 THEN 'Highest' ELSE 'Critical' END
    WHEN '2-HIGH' THEN 'High' WHEN '3-MEDIUM' THEN 'Medium' WHEN '4-NOT SPECIFIED' THEN NULL
    ELSE CASE WHEN o_orderkey % 3 = 0 THEN 'Lowest' ELSE 'Low' END END AS priority,
  CASE WHEN o_orderkey % 17 <> 0 THEN 'Reporter ' || n_nationkey END AS reporter,
  o_orderdate + (o_orderkey % 24) * INTERVAL 1 HOUR AS created,
  last_ship + (o_custkey % 24) * INTERVAL 1 HOUR AS updated,
  'NATION_' || (first_part % 25) || '-E' || first_part AS epic_link,
  CASE WHEN o_orderkey % 9 = 0 AND n_nationkey <> 7 THEN 100 + n_nationkey END AS sprint_id,
  o_orderkey
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
JOIN users ON pos = c_custkey LEFT JOIN li ON l_orderkey = o_orderkey""",
    "tickets": """
SELECT * REPLACE (coalesce(assignee, 'Unassigned') AS assignee, coalesce(priority, 'None') AS priority,
                  coalesce(reporter, 'Unknown') AS reporter) FROM raw_tickets""",
    "enriched": """
SELECT *, CASE WHEN is_resolved THEN CAST(floor((epoch_us(updated) - epoch_us(created)) / 86400000000.0) AS BIGINT) END AS resolution_time_days,
  CAST(created AS DATE) AS created_date, CAST(week(created) AS INTEGER) AS created_week,
  CAST(date_trunc('month', created) AS DATE) AS created_month, CAST(year(created) AS INTEGER) AS created_year,
  CASE priority WHEN 'Critical' THEN 5 WHEN 'High' THEN 4 WHEN 'Medium' THEN 3 WHEN 'Low' THEN 2 WHEN 'Lowest' THEN 1 ELSE 0 END AS priority_score,
  CAST(date_trunc('week', created) AS DATE) AS week_start,
  CASE WHEN is_resolved THEN 'Resolved' WHEN status IN ('In Progress','Active','Development') THEN 'Active'
       WHEN status IN ('To Do','Open','New','Backlog') THEN 'Pending' ELSE 'Other' END AS status_category
FROM (SELECT *, status IN ('Done','Closed','Resolved','Completed') AS is_resolved FROM tickets)""",
    "recent": f"SELECT * FROM enriched WHERE created >= {AS_OF} - INTERVAL 180 DAY",
    "projects": """
SELECT n_name AS key, r_name || ' ' || n_name AS name, CAST(n_nationkey AS VARCHAR) AS id, '' AS description, coalesce(lead, '') AS lead
FROM nation JOIN region ON n_regionkey = r_regionkey
LEFT JOIN (SELECT s_nationkey, min(s_name) AS lead FROM supplier GROUP BY 1) ON s_nationkey = n_nationkey""",
    "epics": """
SELECT 'NATION_' || (p_partkey % 25) || '-E' || p_partkey AS key, 'NATION_' || (p_partkey % 25) AS project,
  CASE WHEN p_partkey % 70 = 0 THEN 'Bugs and Configuration'
       WHEN p_partkey % 98 = 0 THEN '(NATION_' || (p_partkey % 25) || ') Bugs and Configuration Overflow'
       ELSE p_brand || ' ' || p_type || ' ' || p_name END AS summary, '' AS description,
  CASE WHEN p_size % 2 = 0 THEN 'Open' ELSE 'Done' END AS status, 'Unassigned' AS assignee, 'Unknown' AS reporter,
  TIMESTAMP '2000-01-01 00:00:00' + p_partkey * INTERVAL 1 HOUR AS created,
  TIMESTAMP '2000-01-02 00:00:00' + p_partkey * INTERVAL 1 HOUR AS updated, p_partkey, p_type, p_name FROM part""",
    "epic_queries": """
SELECT s_suppkey AS query_id, project, CASE s_suppkey % 6 WHEN 0 THEN substr(lower(summary), 1, 12)
  WHEN 2 THEN p_name || ' qqq ' || p_type
  ELSE replace(replace(replace(replace(lower(summary), 'a', 'x'), 'e', 'x'), 'o', 'x'), 'r', '') END AS title
FROM supplier JOIN epics ON s_suppkey = p_partkey""",
    "topk_queries": "SELECT query_id, CASE WHEN query_id % 10 <> 5 THEN project END AS project, title FROM epic_queries",
    "users": """
SELECT c_custkey AS pos,
  CASE c_custkey % 3 WHEN 0 THEN '5d8b8c8e-' WHEN 1 THEN '557058:' ELSE '712020:' END || c_custkey AS accountId,
  CASE WHEN c_custkey % 50 = 0 THEN 'Automation bot ' || c_custkey ELSE c_mktsegment || ' C' || c_custkey END AS displayName,
  CASE WHEN c_custkey % 11 = 0 THEN '' ELSE lower(c_mktsegment) || '.c' || c_custkey || '@example.com' END AS emailAddress,
  c_acctbal >= 0 AS active FROM customer""",
    "people": "SELECT * FROM users WHERE NOT regexp_matches(lower(displayName), 'automation|system|slack|teams|trello|opsgenie|jira')",
    "user_queries": """
SELECT s_suppkey AS query_id, CASE s_suppkey % 4 WHEN 0 THEN lower(c_mktsegment) || ' c' || c_custkey WHEN 1 THEN lower(c_mktsegment)
  WHEN 2 THEN lower(c_mktsegment) || '.c' || c_custkey || '@example.com' ELSE 'nobody x' || s_suppkey END AS q
FROM supplier JOIN customer ON c_custkey = s_suppkey""",
    "boards": """
SELECT s_suppkey AS id, CASE WHEN s_suppkey % 5 = 0 THEN 'Shared board ' || s_suppkey
  ELSE 'nation_' || s_nationkey || ' board ' || s_suppkey END AS name,
  CASE WHEN s_suppkey % 2 = 0 THEN 'scrum' ELSE 'kanban' END AS type FROM supplier""",
    "sprints": """
SELECT CASE WHEN s_suppkey % 4 <> 1 THEN 100 + s_suppkey END AS id, s_suppkey AS board_id, 'Sprint ' || s_suppkey AS name,
  CASE WHEN s_suppkey % 3 = 2 THEN 'active' ELSE 'closed' END AS state,
  'https://tracker.example.com/sprint/' || (100 + s_suppkey) AS self FROM supplier""",
    "order_keys": """
SELECT o_orderkey, n_name || '-' || o_orderkey AS ticket_key
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""",
    "ticket_requests": """
SELECT c_custkey AS request_id, 'NATION_' || (c_custkey % 25) AS project, 'Request ' || c_custkey AS summary,
  CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END AS description, CASE WHEN c_custkey % 3 = 0 THEN 'Bug' END AS issue_type,
  CASE WHEN c_custkey % 4 = 1 THEN 'High' END AS priority,
  CASE c_custkey % 6 WHEN 0 THEN NULL WHEN 1 THEN lower(c_mktsegment) WHEN 2 THEN ' ' || lower(c_mktsegment) || ' c' || c_custkey
    WHEN 3 THEN 'nobody x' || c_custkey WHEN 4 THEN '557058:' || c_custkey
    ELSE lower(c_mktsegment) || '.c' || c_custkey || '@example.com' END AS assignee,
  CASE c_custkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'EPIC-' || c_custkey WHEN 2 THEN upper(e.summary)
    WHEN 3 THEN 'see ' || e.summary || ' please' ELSE '' END AS epic_link,
  c_acctbal / 1000 AS story_points, c_custkey % 2 = 0 AS assign_active_sprint, CASE WHEN c_custkey % 7 = 0 THEN 'In Progress' END AS status
FROM customer LEFT JOIN epics e ON p_partkey = c_custkey""",
    "epic_requests": """
SELECT s_suppkey AS request_id, 'NATION_' || s_nationkey AS project, s_name AS summary,
  CASE WHEN s_acctbal < 0 THEN 'Negative' END AS description, CASE WHEN s_suppkey % 5 <> 0 THEN q END AS assignee
FROM supplier LEFT JOIN user_queries ON s_suppkey = query_id""",
    "deployment_requests": """
SELECT s_suppkey AS request_id, 'NATION_' || s_nationkey AS project,
  CASE s_suppkey % 5 WHEN 1 THEN [ticket_key] WHEN 2 THEN [ticket_key, 'MISSING-' || s_suppkey] WHEN 3 THEN ['MISSING-' || s_suppkey]
    ELSE CAST([] AS VARCHAR[]) END AS dev_keys,
  CASE WHEN s_suppkey % 5 = 4 OR s_suppkey % 7 = 0 THEN 'Ship ' || s_name END AS title,
  CASE WHEN s_suppkey % 2 = 0 THEN s_name ELSE '' END AS description, CASE WHEN s_suppkey % 3 <> 1 THEN q END AS assignee,
  CASE WHEN s_suppkey % 3 = 0 THEN 'High' END AS priority, CASE WHEN s_suppkey % 4 <> 0 THEN 'pr/' || s_suppkey END AS pr_link,
  CASE WHEN s_suppkey % 6 = 0 THEN s_name END AS qa_contacts,
  CASE WHEN s_suppkey % 8 = 0 THEN 'Check the totals' END AS qa_instructions, s_acctbal / 1000 AS story_points
FROM supplier LEFT JOIN order_keys ON s_suppkey = o_orderkey LEFT JOIN user_queries ON s_suppkey = query_id""",
    "placed": """
SELECT d.* REPLACE (coalesce(t.project, d.project) AS project) FROM deployment_requests d LEFT JOIN tickets t ON t.key = d.dev_keys[1]""",
    "deployment_texts": """
SELECT *, coalesce(title, CASE WHEN len(dev_keys) > 0 THEN '(' || project || ') Deployment ticket for ' || array_to_string(dev_keys, ', ') END) AS final_title,
  concat_ws(e'\\n\\n', nullif(description, ''), 'PR: ' || pr_link, 'QA: ' || qa_contacts, e'QA Instructions:\\n' || qa_instructions,
    CASE WHEN len(dev_keys) > 0 THEN e'Related development tickets:\\n' || array_to_string(
      list_transform(dev_keys, lambda k: '- https://tracker.example.com/browse/' || k), e'\\n') END) AS final_description""",
    "edits": """
SELECT ticket_key, 1 AS seq, CASE o_orderkey % 3 WHEN 1 THEN '' WHEN 2 THEN 'New summary ' || o_orderkey END AS summary,
  NULL AS description, CASE WHEN o_orderkey % 20 = 0 THEN 'High' END AS priority FROM order_keys
UNION ALL
SELECT ticket_key, 2, CASE WHEN o_orderkey % 6 = 2 THEN 'Newer summary ' || o_orderkey ELSE '' END,
  CASE WHEN o_orderkey % 10 = 5 THEN 'Edited' END, NULL FROM order_keys""",
    "assignments": "SELECT ticket_key, query_id AS seq, q AS assignee FROM user_queries JOIN order_keys ON query_id = o_orderkey",
    "transitions": """
SELECT ticket_key, '11' AS id, 'In Progress' AS name, 0 AS pos FROM order_keys UNION ALL
SELECT ticket_key, '21', 'Done', 1 FROM order_keys UNION ALL
SELECT ticket_key, '31', 'Hand to ' || split_part(ticket_key, '-', 1), 2 FROM order_keys""",
    "status_requests": """
SELECT ticket_key, CASE o_orderkey % 3 WHEN 0 THEN 'DONE' WHEN 1 THEN 'in progress' ELSE 'Nope' END AS new_status FROM order_keys""",
    "status_histories": """
SELECT ticket_key, l_linenumber * 1000000 + l_partkey AS seq, CASE l_partkey % 6 WHEN 0 THEN 'Start' WHEN 1 THEN 'finish' WHEN 2 THEN 'Reopen' WHEN 3 THEN 'block'
  WHEN 4 THEN 'Unblock' ELSE 'Vanish' END AS new_status FROM lineitem JOIN order_keys ON l_orderkey = o_orderkey""",
    "workflows": """
SELECT n_name AS workflow, m.pos, m.name, m.to_status, unnest(m.froms) AS from_status FROM (SELECT n_name, unnest([
  {'pos': 0, 'name': 'Start', 'froms': CASE WHEN n_nationkey % 3 = 0 THEN ['To Do'] ELSE ['To Do', 'Open', 'New', 'Backlog'] END, 'to_status': 'In Progress'},
  {'pos': 1, 'name': 'Finish', 'froms': ['In Progress', 'Active', 'Development'], 'to_status': 'Done'},
  {'pos': 2, 'name': 'Reopen', 'froms': CASE WHEN n_nationkey % 2 = 1 THEN [] ELSE ['Done', 'Closed', 'Resolved', 'Completed'] END, 'to_status': 'Open'},
  {'pos': 3, 'name': 'Block', 'froms': ['Open', 'In Progress', 'Active'], 'to_status': 'Blocked'},
  {'pos': 4, 'name': 'Unblock', 'froms': ['Blocked'], 'to_status': 'In Progress'}]) AS m FROM nation)""",
    "history_steps": """
SELECT h.*, t.project, t.status AS first_status, row_number() OVER (PARTITION BY h.ticket_key ORDER BY seq) AS step
FROM status_histories h JOIN tickets t ON t.key = h.ticket_key""",
    "chain_pages": """
SELECT project AS export, page, CASE WHEN lag(page) OVER w IS NOT NULL THEN substr(md5(project || '/' || page), 1, 10) END AS token,
  substr(md5(project || '/' || lead(page) OVER w), 1, 10) AS next, row_number() OVER w AS place, count(*) OVER (PARTITION BY project) AS n_pages, n
FROM (SELECT project, o_orderkey // 1500 AS page, count(*) AS n FROM raw_tickets GROUP BY ALL) WINDOW w AS (PARTITION BY project ORDER BY page)""",
    "broken_pages": """
SELECT export, token, CASE WHEN kind = 2 AND place = n_pages THEN second ELSE next END AS next, CASE WHEN kind = 1 AND place = 2 THEN 2 ELSE 1 END AS answers,
  n, kind, place, n_pages
FROM (SELECT *, CAST(string_split(export, '_')[-1] AS INTEGER) % 5 AS kind, first(next) OVER (PARTITION BY export ORDER BY page) AS second FROM chain_pages)
WHERE NOT (kind = 0 AND place = 2) AND NOT (kind = 3 AND place = 1)""",
    "checked": """
SELECT r.ticket_key, new_status, t.id AS transition_id, t.name AS target,
  CASE WHEN t.id IS NULL THEN 'In Progress, Done, Hand to ' || split_part(r.ticket_key, '-', 1) END AS available
FROM status_requests r LEFT JOIN transitions t ON t.ticket_key = r.ticket_key AND lower(t.name) = lower(new_status)""",
    "activities": """
SELECT CASE WHEN role = 'user' THEN 'message' ELSE 'typing' END AS type, text, conv_id || ':' || turn AS id,
  CAST(conv_id AS VARCHAR) AS conversation_id, role, upper(role) AS from_name FROM conversations""",
    "messages": "SELECT * REPLACE (trim(text, e' \\n\\t\\r') AS text) FROM activities WHERE type = 'message' AND trim(text, e' \\n\\t\\r') <> ''",
    # statistics
    "assignee_stats": """
SELECT assignee, count(*) AS total_tickets, avg(resolution_time_days) AS avg_resolution_time, avg(priority_score) AS avg_priority,
  count(*) FILTER (status_category = 'Resolved') AS resolved_tickets,
  round_even(CAST(count(*) FILTER (status_category = 'Resolved') AS DOUBLE) / count(*) * 100, 1) AS resolution_rate
FROM {base} GROUP BY assignee""",
    "project_stats": """
SELECT project, count(*) AS total_tickets, avg(resolution_time_days) AS avg_resolution_time, avg(priority_score) AS avg_priority,
  count(*) FILTER (status_category = 'Resolved') AS resolved_tickets,
  round_even(CAST(count(*) FILTER (status_category = 'Resolved') AS DOUBLE) / count(*) * 100, 1) AS completion_rate
FROM {base} GROUP BY project""",
    "daily": "SELECT created_date, count(*) AS tickets_created FROM {base} GROUP BY 1",
    "resolved_at": "SELECT updated, count(*) AS tickets_resolved FROM {base} WHERE is_resolved AND updated IS NOT NULL GROUP BY 1",
    "performance": """
SELECT assignee, total_tickets, resolved_tickets, avg_resolution_time, resolution_rate,
  assignee || ': total=' || total_tickets || ', resolved=' || resolved_tickets || ', avg_days='
  || coalesce(printf('%.1f', round_even(avg_resolution_time, 1)), 'nan') || ', rate=' || printf('%.1f', resolution_rate) || '%' AS line
FROM assignee_stats""",
    "linked": """
SELECT epic_link, count(*) AS tickets, count(*) FILTER (status_category = 'Resolved') AS resolved FROM {base} WHERE epic_link IS NOT NULL GROUP BY 1""",
    # resolution
    "needles": "{needles}",
    "name_words": """
SELECT nq, regexp_replace(w[1], '[^a-z0-9]', '', 'g') AS f, CASE WHEN len(w) > 1 THEN regexp_replace(w[-1], '[^a-z0-9]', '', 'g') ELSE '' END AS l
FROM (SELECT nq, string_split_regex(nq, '\\s+') AS w FROM (SELECT DISTINCT lower(trim(q)) AS nq FROM needles WHERE trim(q) <> ''))""",
    "candidates": """
SELECT nq, f, l, unnest(c) AS cand, generate_subscripts(c, 1) AS rank FROM (SELECT nq, f, l, list_filter([
  CASE WHEN contains(nq, '@') THEN nq END, CASE WHEN f <> '' THEN f || '@example.com' END,
  CASE WHEN f <> '' AND l <> '' THEN f || '.' || l || '@example.com' END, CASE WHEN f <> '' AND l <> '' THEN f || l || '@example.com' END,
  CASE WHEN f <> '' AND l <> '' THEN f || '_' || l || '@example.com' END, CASE WHEN f <> '' AND l <> '' THEN f[1] || l || '@example.com' END,
  CASE WHEN NOT contains(nq, '@') THEN nq END], lambda x: x IS NOT NULL) AS c FROM name_words)""",
    "ranked": """
SELECT nq, accountId FROM candidates JOIN users ON contains(lower(emailAddress), cand) OR contains(lower(displayName), cand)
  OR (f <> '' AND l <> '' AND contains(lower(displayName), f) AND contains(lower(displayName), l))
  OR (f <> '' AND l = '' AND starts_with(lower(displayName), f))
QUALIFY row_number() OVER (PARTITION BY nq ORDER BY rank, pos) = 1""",
    "simple": """
SELECT q, accountId FROM (SELECT DISTINCT q FROM needles WHERE q <> '' AND NOT starts_with(q, '5d8b8c8e')
  AND NOT starts_with(q, '557058:') AND NOT starts_with(q, '712020:'))
JOIN users ON contains(lower(emailAddress), lower(q)) OR contains(lower(displayName), lower(q))
QUALIFY row_number() OVER (PARTITION BY q ORDER BY pos) = 1""",
    "resolved_simple": """
SELECT n.q, CASE WHEN starts_with(n.q, '5d8b8c8e') OR starts_with(n.q, '557058:') OR starts_with(n.q, '712020:') THEN n.q ELSE accountId END AS accountId
FROM (SELECT DISTINCT q FROM needles) n LEFT JOIN simple s ON s.q = n.q""",
    "visible": "SELECT string_agg(displayName, ', ' ORDER BY pos) AS names FROM (SELECT pos, displayName FROM users ORDER BY pos LIMIT 5)",
    "titles": "{titles}",
    "epic_hits": """
SELECT t.project, t.q, e.key, e.created, lower(trim(e.summary)) AS s,
  list_distinct(string_split_regex(t.q, '\\s+')) AS qw
FROM (SELECT DISTINCT project, lower(trim(title)) AS q FROM titles WHERE trim(title) <> '' AND NOT regexp_matches(trim(title), '^[A-Z]+-\\d+$', 'i')) t
JOIN epics e ON e.project = t.project""",
    "epic_tiers": """
SELECT project, q, key, tier FROM (SELECT *, CASE WHEN contains(s, q) OR contains(q, s) THEN 1
    WHEN len(list_intersect(qw, string_split_regex(s, '\\s+'))) >= len(qw) / 2.0 THEN 2 END AS tier FROM epic_hits) WHERE tier IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY project, q ORDER BY tier, created DESC, key) = 1""",
    "standard": """
SELECT project, key AS epic_key, CASE tier WHEN 1 THEN 'exact' ELSE 'partial' END AS match FROM (
  SELECT project, key, created, CASE WHEN lower(trim(summary)) = 'bugs and configuration' THEN 1
    WHEN list_contains(string_split(lower(trim(summary)), ' '), 'bugs') AND list_contains(string_split(lower(trim(summary)), ' '), 'configuration') THEN 2 END AS tier FROM epics)
WHERE tier IS NOT NULL QUALIFY row_number() OVER (PARTITION BY project ORDER BY tier, created DESC, key) = 1""",
    "active_boards": """
SELECT b.id, b.name, b.type, coalesce(CAST(s.id AS VARCHAR), string_split(s.self, '/')[-1]) AS sprint_id, s.name AS sprint_name
FROM boards b JOIN sprints s ON s.board_id = b.id WHERE s.state = 'active'""",
    "project_sprints": """
SELECT p.key AS project, a.id AS board_id, a.name AS board_name, a.sprint_id, a.sprint_name
FROM (SELECT key, key IN (SELECT project FROM tickets WHERE sprint_id IS NOT NULL)
        AND EXISTS (SELECT 1 FROM boards WHERE contains(upper(name), upper(key))) AS own FROM projects) p
LEFT JOIN active_boards a ON CASE WHEN own THEN contains(upper(a.name), upper(p.key))
  WHEN (SELECT count(*) FROM boards WHERE type = 'scrum') > 0 THEN a.type = 'scrum' ELSE true END
QUALIFY row_number() OVER (PARTITION BY p.key ORDER BY a.id) = 1""",
}
RELATIONS["deployment_texts"] += " FROM deployment_requests"


def _sql(body: str, **inputs: str) -> str:
    inputs.setdefault("base", "enriched")
    inputs = {k: f"({v})" if k == "base" and " " in v else v for k, v in inputs.items()}
    defs: dict[str, str] = {}

    def need(text: str) -> None:
        for name in RELATIONS:
            if name not in defs and re.search(rf"\b{name}\b", text):
                defs[name] = ""
                filled = RELATIONS[name]
                for key, value in inputs.items():
                    filled = filled.replace("{" + key + "}", value)
                need(filled)
                del defs[name]
                defs[name] = filled

    for key, value in inputs.items():
        body = body.replace("{" + key + "}", value)
    need(body)
    if not defs:
        return body
    return "WITH " + ",\n".join(f"{n} AS ({d.strip()})" for n, d in defs.items()) + "\n" + body


_DETAILS = """t.key, t.summary, coalesce(t.description, '') AS description, t.status, t.assignee, t.reporter, t.created, t.updated,
  t.project, t.issue_type, t.priority"""
_OVERVIEW = """SELECT count(*) AS total_tickets, count(*) FILTER (status_category = 'Active') AS active_tickets,
  count(*) FILTER (status_category = 'Resolved') AS resolved_tickets, count(*) FILTER (status_category = 'Pending') AS pending_tickets,
  coalesce(avg(resolution_time_days), 0) AS avg_resolution_time,
  CAST(count(*) FILTER (status_category = 'Resolved') AS DOUBLE) / count(*) * 100 AS resolution_rate FROM {base} HAVING count(*) > 0"""
_SLOPE = """SELECT CASE WHEN s IS NULL THEN 0.0 ELSE greatest(-1.0, least(1.0, s)) END AS {1} FROM (
  SELECT round(regr_slope(CAST({0} AS DOUBLE), CAST(i AS DOUBLE)), 9) AS s
  FROM (SELECT *, row_number() OVER (ORDER BY {2}) - 1 AS i FROM {3}))"""
_CREATION_TREND = _SLOPE.format("tickets_created", "creation_trend", "created_date", "daily")
_RESOLUTION_TREND = _SLOPE.format("tickets_resolved", "resolution_trend", "updated", "resolved_at")
_WEEKLY = "SELECT week_start, count(*) AS tickets_created FROM {base} GROUP BY 1"
_MONTHLY = "SELECT created_month, count(*) AS tickets_created FROM {base} GROUP BY 1"
_COUNT = "SELECT %s, count(*) AS n FROM {base} GROUP BY 1"
_CROSS = """SELECT r.%(r)s, c.%(c)s, coalesce(n, 0) AS n FROM (SELECT DISTINCT %(r)s FROM {base}) r
CROSS JOIN (SELECT DISTINCT %(c)s FROM {base}) c
LEFT JOIN (SELECT %(r)s, %(c)s, count(*) AS n FROM {base} GROUP BY ALL) x ON x.%(r)s = r.%(r)s AND x.%(c)s = c.%(c)s"""
_FLOW = _CROSS % {"r": "project", "c": "status_category"}
_BY_PROJECT = _CROSS % {"r": "project", "c": "priority"}
_TIMES = """SELECT priority, avg(resolution_time_days) AS mean_days, median(resolution_time_days) AS median_days,
  count(resolution_time_days) AS n_days FROM {base} GROUP BY 1"""
_ROLLUP = """SELECT key AS epic_key, project, coalesce(tickets, 0) AS tickets, coalesce(resolved, 0) AS resolved,
  coalesce(round_even(CAST(resolved AS DOUBLE) / tickets * 100, 1), 0.0) AS progress FROM epics LEFT JOIN linked ON key = epic_link"""


def _top(source: str, order: str, limit: int | None, where: str = "true") -> str:
    return f"SELECT * FROM {source} WHERE {where} ORDER BY {order}" + (f" LIMIT {limit}" if limit else "")


_TOP_ASSIGNEES = _top("assignee_stats", "total_tickets DESC, assignee", 10)
_EFFICIENT = _top("assignee_stats", "resolution_rate DESC, total_tickets DESC, assignee", 5, "total_tickets >= 3")
_SLOWEST = _top("assignee_stats", "resolution_rate, total_tickets DESC, assignee", 5, "total_tickets >= 3")
_ACTIVE_PROJECTS = _top("project_stats", "total_tickets DESC, project", 10)
_COMPLETED = _top("project_stats", "completion_rate DESC, total_tickets DESC, project", 5)

_STATS = ["total_tickets", "avg_resolution_time", "avg_priority", "resolved_tickets"]
_A, _P = _STATS + ["resolution_rate"], _STATS + ["completion_rate"]
_REPORT = [
    ("overview", _OVERVIEW, [], ["total_tickets", "active_tickets", "resolved_tickets", "pending_tickets", "avg_resolution_time", "resolution_rate"]),
    ("assignees.assignee_stats", "SELECT * FROM assignee_stats", ["assignee"], _A),
    ("assignees.top_assignees", _TOP_ASSIGNEES, ["assignee"], _A),
    ("assignees.most_efficient", _EFFICIENT, ["assignee"], _A),
    ("assignees.slowest_resolvers", _SLOWEST, ["assignee"], _A),
    ("projects.project_stats", "SELECT * FROM project_stats", ["project"], _P),
    ("projects.most_active_projects", _ACTIVE_PROJECTS, ["project"], _P),
    ("projects.most_completed_projects", _COMPLETED, ["project"], _P),
    ("projects.project_count", "SELECT count(DISTINCT project) AS project_count FROM {base}", [], ["project_count"]),
    ("trends.daily_creation", "SELECT * FROM daily", ["created_date"], ["tickets_created"]),
    ("trends.weekly_creation", _WEEKLY, ["week_start"], ["tickets_created"]),
    ("trends.monthly_creation", _MONTHLY, ["created_month"], ["tickets_created"]),
    ("trends.daily_resolution", "SELECT * FROM resolved_at", ["updated"], ["tickets_resolved"]),
    ("trends.creation_trend", _CREATION_TREND, [], ["creation_trend"]),
    ("trends.resolution_trend", _RESOLUTION_TREND, [], ["resolution_trend"]),
    ("status.status_distribution", _COUNT % "status", ["status"], ["n"]),
    ("status.status_category_distribution", _COUNT % "status_category", ["status_category"], ["n"]),
    ("status.status_flow", _FLOW, ["project", "status_category"], ["n"]),
    ("status.status_count", "SELECT count(DISTINCT status) AS status_count FROM {base}", [], ["status_count"]),
    ("priority.priority_distribution", _COUNT % "priority", ["priority"], ["n"]),
    ("priority.priority_by_project", _BY_PROJECT, ["project", "priority"], ["n"]),
    ("priority.priority_resolution_times", _TIMES, ["priority"], ["mean_days", "median_days", "n_days"]),
    ("total_records", "SELECT count(*) AS total_records FROM {base}", [], ["total_records"]),
    ("epics.epic_progress", _ROLLUP, ["epic_key", "project"], ["tickets", "resolved", "progress"]),
    ("epics.epic_count", "SELECT count(*) AS epic_count FROM epics", [], ["epic_count"]),
    ("data_freshness", "SELECT epoch(TIMESTAMP '2001-08-01 06:30:00') AS data_freshness", [], ["data_freshness"]),
]


def _ratios(pairs: str) -> str:
    """``a, b, ratio`` of the distinct text pairs ``a, b`` that a query gives, for ``b`` of less than 200 characters.

    ``runs`` has how far both texts agree from each place of a and place of b on. An interval of both is parted at its longest
    common run (the first in a, then in b) into what is left and what is right of it, until nothing is common; the ratio is twice
    the characters in runs over all characters.
    """
    return f"""(WITH RECURSIVE pairs AS MATERIALIZED (SELECT row_number() OVER () AS pid, a, b FROM (SELECT DISTINCT a, b FROM ({pairs}))),
      a_chars AS (SELECT pid, i, substr(a, i + 1, 1) AS c FROM pairs, range(0, length(a)) r(i)),
      b_chars AS (SELECT pid, j, substr(b, j + 1, 1) AS c FROM pairs, range(0, length(b)) r(j)),
      equal AS (SELECT pid, i, j, i - row_number() OVER (PARTITION BY pid, i - j ORDER BY i) AS island FROM a_chars JOIN b_chars USING (pid, c)),
      runs AS MATERIALIZED (SELECT pid, i, j, max(i) OVER (PARTITION BY pid, i - j, island) - i + 1 AS n FROM equal),
      parts AS (SELECT pid, CAST(0 AS BIGINT) AS alo, CAST(length(a) AS BIGINT) AS ahi, CAST(0 AS BIGINT) AS blo, CAST(length(b) AS BIGINT) AS bhi, CAST(0 AS BIGINT) AS got FROM pairs
        UNION ALL SELECT pid, x.alo, x.ahi, x.blo, x.bhi, x.got FROM (
          SELECT pid, unnest([{{'alo': alo, 'ahi': m[2], 'blo': blo, 'bhi': m[3], 'got': -m[1]}}, {{'alo': m[2] - m[1], 'ahi': ahi, 'blo': m[3] - m[1], 'bhi': bhi, 'got': 0}}]) AS x
          FROM (SELECT p.pid, alo, ahi, blo, bhi, min([-least(n, ahi - i, bhi - j), i, j]) AS m
                FROM parts p JOIN runs r ON r.pid = p.pid AND i >= alo AND i < ahi AND j >= blo AND j < bhi GROUP BY p.pid, alo, ahi, blo, bhi))),
      sums AS (SELECT pid, sum(got) AS matched FROM parts GROUP BY pid)
      SELECT a, b, CASE WHEN length(a) + length(b) = 0 THEN 1.0 ELSE CAST(2 * matched AS DOUBLE) / (length(a) + length(b)) END AS ratio FROM pairs JOIN sums USING (pid))"""


def _tall() -> str:
    parts = []
    for section, body, keys, metrics in _REPORT:
        dims = [f"CAST({k} AS VARCHAR) AS dim{i + 1}" for i, k in enumerate(keys)]
        dims += [f"CAST(NULL AS VARCHAR) AS dim{i + 1}" for i in range(len(keys), 2)]
        parts += [f"SELECT '{section}' AS section, '{m}' AS metric, {', '.join(dims)}, CAST({m} AS DOUBLE) AS value FROM ({body})"
                  for m in metrics]
    return "\nUNION ALL\n".join(parts)


_RANKED_OF = """CASE WHEN {ids} THEN n.q ELSE r.accountId END"""


def oracle() -> dict[str, str]:
    times = "epoch_us(created) AS created, epoch_us(updated) AS updated, created AS created_local, updated AS updated_local"
    tool = "starts_with({0}, '5d8b8c8e') OR starts_with({0}, '557058:') OR starts_with({0}, '712020:')"
    search = "starts_with({0}, '5d') OR starts_with({0}, '557058:') OR starts_with({0}, '712020:')"
    q = {
        "flatten_issues": f"""SELECT key, summary, description, status, assignee, project, issue_type, priority, reporter, epic_link,
            CAST(NULL AS DOUBLE) AS story_points, {times} FROM tickets""",
        "flatten_epics": f"SELECT key, summary, description, status, assignee, reporter, project, {times} FROM epics",
        "read_users": "SELECT accountId, displayName, emailAddress, active FROM users",
        "read_projects": "SELECT * FROM projects",
        "list_projects": "SELECT * FROM projects",
        "read_boards": "SELECT * FROM boards",
        "read_sprints": "SELECT * FROM sprints",
        "users_of_pages": "SELECT row_number() OVER (ORDER BY pos) - 1 AS pos, accountId, displayName, emailAddress, active FROM users",
        "resolve_users_of_pages": ("""SELECT query_id, u.q, accountId FROM user_queries u LEFT JOIN ranked r ON r.nq = lower(trim(u.q))""",
                                   {"needles": "SELECT q FROM user_queries"}),
        "issues_of_pages": "SELECT row_number() OVER (ORDER BY project, o_orderkey) - 1 AS pos, key, status, assignee FROM tickets",
        "page_problems": """SELECT * FROM (WITH RECURSIVE walk AS (
              SELECT export, coalesce(token, '') AS token, next, 0 AS page FROM broken_pages WHERE token IS NULL
              UNION ALL SELECT w.export, b.token, b.next, page + 1 FROM walk w JOIN broken_pages b ON b.export = w.export AND b.token = w.next WHERE page <= n_pages),
            reached AS (SELECT export, token, any_value(next) AS next, min(page) AS page FROM walk GROUP BY export, token)
            SELECT r.export, 'missing' AS problem, r.next AS token, CAST(1 AS BIGINT) AS pages FROM reached r
              WHERE r.next IS NOT NULL AND NOT EXISTS (SELECT 1 FROM broken_pages b WHERE b.export = r.export AND b.token = r.next)
            UNION ALL SELECT DISTINCT r.export, 'looping', r.next, CAST(1 AS BIGINT) FROM reached r JOIN reached v ON v.export = r.export AND v.token = r.next WHERE v.page <= r.page
            UNION ALL SELECT export, 'repeated', token, CAST(2 AS BIGINT) FROM broken_pages WHERE answers = 2 AND n > 1
            UNION ALL SELECT export, 'unreached', coalesce(token, ''), CAST(1 AS BIGINT) FROM broken_pages b
              WHERE NOT EXISTS (SELECT 1 FROM reached r WHERE r.export = b.export AND r.token = coalesce(b.token, ''))
            UNION ALL SELECT export, 'headless', '', count(*) FROM broken_pages GROUP BY export HAVING count(*) FILTER (token IS NULL) = 0)""",
        "transition_history": """SELECT * FROM (WITH RECURSIVE steps AS (
              SELECT ticket_key, step, seq, new_status, project, first_status AS from_status FROM history_steps WHERE step = 1
              UNION ALL SELECT h.ticket_key, h.step, h.seq, h.new_status, h.project, coalesce(wf.to_status, s.from_status)
                FROM steps s JOIN history_steps h ON h.ticket_key = s.ticket_key AND h.step = s.step + 1
                LEFT JOIN workflows wf ON wf.workflow = s.project AND wf.from_status = s.from_status AND lower(wf.name) = lower(s.new_status)),
            options AS (SELECT workflow, from_status, string_agg(name, ', ' ORDER BY pos) AS names FROM workflows GROUP BY ALL)
            SELECT ticket_key, seq, new_status, s.from_status, coalesce(wf.to_status, s.from_status) AS to_status, wf.to_status IS NOT NULL AS accepted,
              CASE WHEN wf.to_status IS NULL THEN 'No transition to ''' || new_status || '''. Available: ' || coalesce(o.names, '') END AS error
            FROM steps s LEFT JOIN workflows wf ON wf.workflow = s.project AND wf.from_status = s.from_status AND lower(wf.name) = lower(s.new_status)
            LEFT JOIN options o ON o.workflow = s.project AND o.from_status = s.from_status)""",
        "apply_transitions_in_order": """SELECT * FROM (WITH RECURSIVE steps AS (
              SELECT ticket_key, CAST(0 AS BIGINT) AS step, project, first_status, first_status AS status FROM history_steps WHERE step = 1
              UNION ALL SELECT h.ticket_key, h.step, h.project, s.first_status, coalesce(wf.to_status, s.status)
                FROM steps s JOIN history_steps h ON h.ticket_key = s.ticket_key AND h.step = s.step + 1
                LEFT JOIN workflows wf ON wf.workflow = h.project AND wf.from_status = s.status AND lower(wf.name) = lower(h.new_status))
            SELECT ticket_key AS key, first_status AS old_status, arg_max(status, step) AS status FROM steps GROUP BY ALL)""",
        "parse_activities": """SELECT type, text, id, 'https://chat.example.com' AS serviceUrl, conversation_id, from_name,
            'Bot' AS recipient_name FROM activities""",
        "load_chat_history": "SELECT * FROM conversations",
        "recent_tickets": f"SELECT key, project, status, created FROM tickets WHERE created >= {AS_OF} - INTERVAL 180 DAY",
        "search_tickets": f"""SELECT key, summary, status, assignee, 'https://tracker.example.com/browse/' || key AS url FROM tickets
            WHERE priority IN ('High', 'Critical') AND status <> 'Done' AND created >= {AS_OF} - INTERVAL 180 DAY""",
        "search_tickets_dated": """SELECT key, summary, status, assignee, 'https://tracker.example.com/browse/' || key AS url FROM tickets
            WHERE created < TIMESTAMP '1999-01-01'""",
        "project_status_filter": "SELECT key, status FROM tickets WHERE project = 'NATION_3' AND status <> 'Done'",
        "ticket_details": f"SELECT {_DETAILS} FROM tickets t WHERE key = (SELECT min(key) FROM tickets)",
        "ticket_details_batch": f"""SELECT {_DETAILS.replace('t.key', 'k.key').replace("coalesce(t.description, '')", "CASE WHEN t.key IS NOT NULL THEN coalesce(t.description, '') END")}
            FROM (SELECT DISTINCT unnest(dev_keys) AS key FROM deployment_requests) k LEFT JOIN tickets t ON t.key = k.key""",
        "list_epics": "SELECT key, summary, description, status, assignee, reporter, created, updated, project FROM epics",
        "list_epics_of_project": """SELECT key, summary, description, status, assignee, reporter, created, updated, project FROM epics
            WHERE project = 'NATION_3'""",
        "epics_of_tickets": "SELECT key, summary, project, created FROM tickets WHERE issue_type = 'Epic'",
        "filter_assignee_any": (f"""SELECT key, assignee_id FROM tickets WHERE assignee_id IN (
            SELECT CASE WHEN {search.format('n.q')} THEN n.q ELSE coalesce(accountId, n.q) END
            FROM needles n LEFT JOIN ranked r ON r.nq = lower(trim(n.q)))""",
            {"needles": "SELECT q FROM user_queries UNION ALL SELECT '5d8b8c8e-' || query_id FROM user_queries"}),
        "has_sprint": "SELECT DISTINCT project FROM tickets WHERE sprint_id IS NOT NULL",
        "min_tickets_filter": "SELECT assignee, total_tickets FROM assignee_stats WHERE total_tickets >= 12",
        "assignee_contains": "SELECT key, assignee FROM tickets WHERE contains(lower(assignee), '#00000012')",
        "assignee_drilldown": """SELECT key, summary, project, status, status_category, priority, created, updated FROM enriched
            WHERE regexp_matches(lower(assignee), '#0000001.5$')""",
        "exclude_bot_users": "SELECT * FROM people",
        "message_events": "SELECT id, text FROM messages",
        "is_account_id": f"""SELECT a AS accountId, {tool.format('a')} AS tool, {search.format('a')} AS search FROM (
            SELECT accountId AS a FROM users UNION ALL SELECT '5d' || pos FROM users UNION ALL SELECT displayName FROM users)""",
        "is_ticket_key": """SELECT epic_link, regexp_matches(trim(epic_link), '^[A-Z]+-\\d+$', 'i') AS is_key FROM (
            SELECT epic_link FROM ticket_requests WHERE epic_link IS NOT NULL
            UNION ALL SELECT ' ' || p_type || '-' || p_size || ' ' FROM part)""",
        "resolved_only": "SELECT key, status, updated FROM enriched WHERE is_resolved",
        "non_null_metric": "SELECT key, resolution_time_days FROM enriched WHERE resolution_time_days IS NOT NULL",
        "resolve_users_ranked": ("""SELECT query_id, u.q, accountId FROM user_queries u LEFT JOIN ranked r ON r.nq = lower(trim(u.q))""",
                                 {"needles": "SELECT q FROM user_queries"}),
        "resolve_users_simple": ("SELECT query_id, u.q, accountId FROM user_queries u LEFT JOIN resolved_simple r ON r.q = u.q",
                                 {"needles": "SELECT q FROM user_queries"}),
        "resolve_epics_direct": ("""SELECT query_id, t.project, t.title, key AS epic_key, CASE tier WHEN 1 THEN 'contains' WHEN 2 THEN 'words' END AS tier
            FROM epic_queries t LEFT JOIN epic_tiers e ON e.project = t.project AND e.q = lower(trim(t.title))""",
                                 {"titles": "SELECT project, title FROM epic_queries"}),
        "epic_title_topk_contained": """SELECT query_id, CAST(NULL AS VARCHAR) AS project, title, key AS epic_key, CAST(1.0 AS DOUBLE) AS score,
              CAST(row_number() OVER w AS INTEGER) AS rank, trim(summary) AS epic_title
            FROM (SELECT min(p_partkey) AS query_id, p_type AS title FROM part GROUP BY p_type) JOIN epics ON contains(lower(summary), lower(title))
            WINDOW w AS (PARTITION BY title ORDER BY created DESC, key) QUALIFY row_number() OVER w <= 5""",
        "match_standard_epic": """SELECT p.key AS project, epic_key, coalesce(match, 'create') AS match,
              CASE WHEN epic_key IS NULL THEN '(' || p.key || ') Bugs and Configuration' END AS new_title
            FROM projects p LEFT JOIN standard s ON s.project = p.key""",
        "standard_epics_to_create": """SELECT project, '(' || project || ') Bugs and Configuration' AS summary,
              'Auto-created epic for deployment & configuration tickets in ' || project AS description, 'Epic' AS issue_type
            FROM (SELECT project FROM epic_requests UNION SELECT 'NEW_' || c_mktsegment FROM customer)
            WHERE project NOT IN (SELECT project FROM standard)""",
        "active_sprint": "SELECT * FROM project_sprints",
        "ticket_project_lookup": "SELECT request_id, project FROM placed",
        "link_edges": "SELECT 'DEPLOY-' || request_id AS src, unnest(dev_keys) AS dst, 'Relates' AS link_type FROM deployment_requests",
        "sprint_membership": """SELECT t.key, t.project, s.sprint_id, s.sprint_id IS NOT NULL AS added
            FROM tickets t LEFT JOIN project_sprints s ON s.project = t.project""",
        "validate_transition": "SELECT * FROM checked",
        "story_points_field": """SELECT coalesce((SELECT 'customfield_' || p_partkey FROM part WHERE p_size = 13 ORDER BY p_partkey LIMIT 1),
            'customfield_10016') AS field_id""",
        "overview_metrics": _OVERVIEW,
        "assignee_stats": "SELECT * FROM assignee_stats",
        "project_stats": "SELECT * FROM project_stats",
        "daily_creation": "SELECT * FROM daily",
        "weekly_creation": _WEEKLY,
        "monthly_creation": _MONTHLY,
        "resolution_series": "SELECT * FROM resolved_at",
        "resolution_series_by_day": """SELECT CAST(updated AS DATE) AS updated, CAST(sum(tickets_resolved) AS BIGINT) AS tickets_resolved
            FROM resolved_at GROUP BY 1""",
        "creation_trend": _CREATION_TREND,
        "resolution_trend": _RESOLUTION_TREND,
        "creation_trend_of_blocks": _CREATION_TREND,
        "resolution_trend_of_blocks": _RESOLUTION_TREND,
        "event_trend": _SLOPE.format("n", "event_trend", "d", "(SELECT CAST(ts AS DATE) AS d, count(*) AS n FROM events GROUP BY 1)"),
        "status_distribution": _COUNT % "status",
        "status_category_distribution": _COUNT % "status_category",
        "status_flow": _FLOW,
        "priority_distribution": _COUNT % "priority",
        "priority_by_project": _BY_PROJECT,
        "priority_resolution_times": _TIMES,
        "cardinalities": """SELECT count(DISTINCT project) AS project_count, count(DISTINCT status) AS status_count, count(*) AS total_records
            FROM enriched""",
        "epic_rollup": _ROLLUP,
        "drilldown_counts": """SELECT CASE WHEN grouping(status) = 0 THEN 'status' WHEN grouping(project) = 0 THEN 'project'
              WHEN grouping(status_category) = 0 THEN 'status_category' ELSE 'rows' END AS dimension,
              coalesce(status, project, status_category) AS value, count(*) AS n
            FROM enriched WHERE regexp_matches(lower(assignee), '#0000001') GROUP BY GROUPING SETS ((status), (project), (status_category), ())""",
        "maintained_report": (_tall(), {"base": "recent"}),
        "comprehensive_report": (_tall(), {"base": "recent"}),
        "last_n_turns": """SELECT conv_id, turn, role, text FROM conversations
            QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 5""",
        "last_turns_stream": """SELECT conv_id, turn, role, text FROM conversations
            QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 5""",
        "snapshot_overview": _OVERVIEW,
        "limits_clamped": _top("performance", "total_tickets DESC, assignee", 1),
        "series_index": "SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS idx FROM (SELECT DISTINCT ts FROM events)",
        "top_assignees": _TOP_ASSIGNEES,
        "most_efficient": _EFFICIENT,
        "slowest_resolvers": _SLOWEST,
        "most_active_projects": _ACTIVE_PROJECTS,
        "most_completed_projects": _COMPLETED,
        "top_assignees_by_rate": _top("performance", "resolution_rate DESC, total_tickets DESC, assignee", 10),
        "top_assignees_by_resolved": _top("performance", "resolved_tickets DESC, total_tickets DESC, assignee", 10),
        "top_assignees_by_time": _top("performance", "avg_resolution_time, total_tickets DESC, assignee", 10, "avg_resolution_time IS NOT NULL"),
        "assignee_performance_summary": _top("performance", "total_tickets DESC, assignee", 25, "total_tickets >= 5"),
        "assignee_table": """SELECT assignee, total_tickets, resolved_tickets, avg_resolution_time, resolution_rate FROM assignee_stats
            WHERE total_tickets >= 2""",
        "search_users": """SELECT query_id, q, pos, displayName, emailAddress, accountId, CAST(find_pos AS INTEGER) AS find_pos,
              CAST(rank AS INTEGER) AS rank, greatest(total - 10, 0) AS overflow FROM (
              SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY find_pos, pos) AS rank, count(*) OVER (PARTITION BY query_id) AS total FROM (
                SELECT query_id, q, people.*, instr(lower(displayName), lower(trim(q))) - 1 AS find_pos FROM user_queries
                JOIN people ON contains(lower(displayName), lower(trim(q))) OR contains(lower(emailAddress), lower(trim(q))))) WHERE rank <= 10""",
        "assignee_detail": _top("performance", "total_tickets DESC, assignee", 1, "contains(lower(assignee), '#00000014')"),
        "first_visible_users": "SELECT names AS visible_users FROM visible",
        "page_concatenation": """SELECT name, count(*) AS n, count(DISTINCT key) AS n_keys FROM (
            SELECT issue_type AS name, key FROM tickets UNION ALL SELECT 'Epic', key FROM epics) GROUP BY name""",
        "word_overlap": """SELECT query_id, len(list_intersect(qw, sw)) / CAST(len(qw) AS DOUBLE) AS share FROM (
            SELECT query_id, list_distinct(string_split_regex(lower(trim(title)), '\\s+')) AS qw,
                   list_distinct(string_split_regex(lower(trim(summary)), '\\s+')) AS sw
            FROM epic_queries JOIN epics ON query_id = p_partkey)""",
        "word_subset": """SELECT key, list_has_all(string_split(lower(summary), ' '), ['bugs', 'configuration']) AS has_all FROM epics""",
        "ticket_metrics": """SELECT key, resolution_time_days, is_resolved, created_date, created_week, created_month, created_year,
            priority_score, status_category, week_start FROM enriched""",
        "ticket_defaults": "SELECT assignee, priority, reporter, count(*) AS n FROM tickets GROUP BY ALL",
        "parse_timestamps": """SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 7 <> 0 THEN epoch_us(l_shipdate - INTERVAL 5 HOUR) END AS micros,
            CASE WHEN l_orderkey % 7 <> 0 THEN l_shipdate END AS local FROM lineitem""",
        "browse_urls": "SELECT key, 'https://tracker.example.com/browse/' || key AS url FROM tickets",
        "normalised_text": """SELECT conv_id, turn, lower(t) AS lower_text, upper(role) AS upper_role, CAST(len(w) AS INTEGER) AS n_words,
              CAST(len(list_distinct(list_filter(w, lambda x: len(x) > 3))) AS INTEGER) AS n_long_words
            FROM (SELECT *, list_filter(string_split_regex(t, '\\s+'), lambda x: x <> '') AS w FROM (SELECT *, trim(text, e' \\n\\t\\r') AS t FROM conversations))""",
        "name_parts": ("""SELECT query_id, f AS first, l AS last, c AS candidates FROM user_queries
            JOIN (SELECT nq, f, l, string_agg(cand, '|' ORDER BY rank) AS c FROM candidates GROUP BY ALL) ON nq = lower(trim(q))""",
                       {"needles": "SELECT q FROM user_queries"}),
        "find_positions": "SELECT pos, CAST(instr(lower(displayName), 'c1') - 1 AS INTEGER) AS find_pos FROM users",
        "deployment_texts": """SELECT request_id, final_title AS summary, final_description AS description,
            '(' || project || ') Bugs and Configuration' AS epic_title FROM deployment_texts""",
        "key_lists": "SELECT p_partkey, upper(p_type) || '-' || p_size || '|' || upper(p_name) AS keys FROM part",
        "positive_points": "SELECT request_id, CASE WHEN story_points > 0 THEN story_points END AS story_points FROM ticket_requests",
        "truncated_text": "SELECT doc_id, substr(text, 1, 50000) AS text FROM documents",
        "build_ticket_rows": (f"""SELECT request_id, t.project, t.summary, coalesce(t.description, '') AS description, coalesce(t.issue_type, 'Task') AS issue_type,
              account AS assignee_id, CASE WHEN is_key THEN t.epic_link ELSE e.key END AS epic_key, coalesce(t.priority, 'Medium') AS priority,
              CASE WHEN story_points > 0 THEN story_points END AS story_points, CASE WHEN assign_active_sprint THEN s.sprint_id END AS sprint_id,
              coalesce(t.status, 'To Do') AS status,
              CASE WHEN t.assignee IS NOT NULL AND account IS NULL THEN 'unassigned; provide accountId to assign' END AS assignee_note,
              CASE WHEN is_key OR coalesce(t.epic_link, '') = '' THEN NULL WHEN e.key IS NOT NULL THEN 'linked to ' || e.key || ' for ''' || t.epic_link || ''''
                ELSE 'epic ''' || t.epic_link || ''' not found in ' || t.project END AS epic_note
            FROM (SELECT x.*, CASE WHEN {tool.format('x.assignee')} THEN x.assignee ELSE accountId END AS account,
                    coalesce(regexp_matches(trim(x.epic_link), '^[A-Z]+-\\d+$', 'i'), false) AS is_key
                  FROM ticket_requests x LEFT JOIN ranked r ON r.nq = lower(trim(x.assignee))) t
            LEFT JOIN epic_tiers e ON e.project = t.project AND e.q = lower(trim(t.epic_link))
            LEFT JOIN project_sprints s ON s.project = t.project""",
            {"needles": f"SELECT assignee AS q FROM ticket_requests WHERE assignee IS NOT NULL AND NOT ({tool.format('assignee')})",
             "titles": "SELECT project, epic_link AS title FROM ticket_requests WHERE epic_link IS NOT NULL"}),
        "build_epic_rows": ("""SELECT request_id, project, summary, coalesce(description, '') AS description, 'Epic' AS issue_type,
              accountId AS assignee_id, error IS NULL AS accepted, error FROM (
              SELECT r.*, accountId, CASE WHEN assignee IS NOT NULL AND accountId IS NULL THEN
                'User ''' || assignee || ''' not found. Available users: ' || (SELECT names FROM visible) || '...' END AS error
              FROM epic_requests r LEFT JOIN resolved_simple s ON s.q = r.assignee)""",
            {"needles": "SELECT assignee AS q FROM epic_requests WHERE assignee IS NOT NULL"}),
        "build_deployment_rows": ("""SELECT request_id, project, title AS summary, description, 'Task' AS issue_type, accountId AS assignee_id,
              epic_key, new_epic_title, coalesce(priority, 'Medium') AS priority, CASE WHEN story_points > 0 THEN story_points END AS story_points,
              sprint_id, 'To Do' AS status, dev_keys, error IS NULL AS accepted, error FROM (
              SELECT p.request_id, p.project, coalesce(p.title, CASE WHEN len(p.dev_keys) > 0 THEN '(' || p.project || ') Deployment ticket for '
                    || array_to_string(p.dev_keys, ', ') END) AS title, d.final_description AS description, accountId, t.epic_key,
                CASE WHEN t.epic_key IS NULL THEN '(' || p.project || ') Bugs and Configuration' END AS new_epic_title, p.priority, p.story_points,
                ps.sprint_id, array_to_string(p.dev_keys, ',') AS dev_keys,
                CASE WHEN p.assignee IS NOT NULL AND accountId IS NULL THEN
                  'User ''' || p.assignee || ''' not found. Available users: ' || (SELECT names FROM visible) || '...'
                  WHEN p.title IS NULL AND len(p.dev_keys) = 0 THEN 'no title and no development tickets' END AS error
              FROM placed p JOIN deployment_texts d ON d.request_id = p.request_id LEFT JOIN resolved_simple s ON s.q = p.assignee
              LEFT JOIN standard t ON t.project = p.project LEFT JOIN project_sprints ps ON ps.project = p.project)""",
            {"needles": "SELECT assignee AS q FROM deployment_requests WHERE assignee IS NOT NULL"}),
        "apply_edits": """SELECT t.key, coalesce(s, t.summary) AS summary, coalesce(d, t.description) AS description,
              coalesce(p, t.priority) AS priority, coalesce(s, d, p) IS NOT NULL AS accepted,
              CASE WHEN coalesce(s, d, p) IS NULL THEN 'No fields provided to update' END AS error
            FROM tickets t JOIN (SELECT ticket_key, arg_max(summary, seq) FILTER (summary <> '') AS s,
              arg_max(description, seq) FILTER (description <> '') AS d, arg_max(priority, seq) FILTER (priority <> '') AS p
              FROM edits GROUP BY ticket_key) ON ticket_key = t.key""",
        "apply_assignments": ("""SELECT t.key, coalesce(accountId, t.assignee_id) AS assignee_id, t.assignee_id AS old_assignee_id,
              accountId IS NOT NULL AS accepted, CASE WHEN accountId IS NULL THEN
                'User ''' || a.assignee || ''' not found. Available users: ' || (SELECT names FROM visible) || '...' END AS error
            FROM assignments a JOIN tickets t ON t.key = a.ticket_key LEFT JOIN resolved_simple s ON s.q = a.assignee""",
            {"needles": "SELECT assignee AS q FROM assignments"}),
        "apply_transitions": """SELECT key, t.status AS old_status, coalesce(target, t.status) AS status, transition_id, transition_id IS NOT NULL AS accepted,
              CASE WHEN transition_id IS NULL THEN 'No transition to ''' || new_status || '''. Available: ' || available END AS error
            FROM checked JOIN tickets t ON t.key = ticket_key""",
        "title_ratios": f"""SELECT query_id, ratio FROM epic_queries q JOIN epics e ON query_id = p_partkey
            JOIN {_ratios("SELECT lower(trim(title)) AS a, lower(trim(summary)) AS b FROM epic_queries JOIN epics ON query_id = p_partkey")} r
            ON r.a = lower(trim(title)) AND r.b = lower(trim(summary))""",
        "resolve_epics": (f"""SELECT t.query_id, t.project, t.title, coalesce(e.key, s.key) AS epic_key,
              CASE WHEN e.tier = 1 THEN 'contains' WHEN e.tier = 2 THEN 'words' WHEN s.key IS NOT NULL THEN 'ratio' END AS tier, CASE WHEN e.key IS NULL THEN s.ratio END AS ratio
            FROM epic_queries t LEFT JOIN epic_tiers e ON e.project = t.project AND e.q = lower(trim(t.title))
            LEFT JOIN (SELECT h.project, h.q, h.key, ratio FROM epic_hits h JOIN {_ratios("SELECT h.q AS a, h.s AS b FROM epic_hits h LEFT JOIN epic_tiers x ON x.project = h.project AND x.q = h.q WHERE x.q IS NULL AND h.s <> ''")} r
              ON r.a = h.q AND r.b = h.s WHERE ratio >= 0.5 QUALIFY row_number() OVER (PARTITION BY h.project, h.q ORDER BY ratio DESC, h.created DESC, h.key) = 1) s
            ON s.project = t.project AND s.q = lower(trim(t.title))""", {"titles": "SELECT project, title FROM epic_queries"}),
        "epic_title_topk": (f"""SELECT query_id, project, title, epic_key, epic_title, score, CAST(rank AS INTEGER) AS rank FROM (
            SELECT t.query_id, t.project, t.title, e.key AS epic_key, trim(e.summary) AS epic_title,
              CASE WHEN contains(lower(trim(e.summary)), lower(trim(t.title))) THEN 1.0 ELSE r.ratio END AS score,
              row_number() OVER (PARTITION BY t.query_id ORDER BY CASE WHEN contains(lower(trim(e.summary)), lower(trim(t.title))) THEN 1.0 ELSE r.ratio END DESC, e.created DESC, e.key) AS rank
            FROM topk_queries t JOIN epics e ON t.project IS NULL OR e.project = t.project
            JOIN {_ratios("SELECT lower(trim(t.title)) AS a, lower(trim(e.summary)) AS b FROM topk_queries t JOIN epics e ON t.project IS NULL OR e.project = t.project")} r
            ON r.a = lower(trim(t.title)) AND r.b = lower(trim(e.summary))) WHERE rank <= 10"""),
        "reply_rows": """SELECT 'https://chat.example.com/v3/conversations/' || conversation_id || '/activities/' || id AS reply_url, 'message' AS type,
            'Re: ' || text AS text, 'bot' AS from_id, role AS recipient_id, id AS replyToId FROM messages""",
        "message_stream": """SELECT conv_id, turn, trim(text, e' \\n\\t\\r') AS text FROM conversations
            WHERE role = 'user' AND trim(text, e' \\n\\t\\r') <> ''""",
    }
    for name in ("resolve_users_ranked", "resolve_users_simple", "search_users"):
        q[name.replace("_ranked", "") + "_indexed"] = q[name]
    return {name: _sql(v) if isinstance(v, str) else _sql(v[0], **v[1]) for name, v in q.items()}
