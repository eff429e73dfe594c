"""DuckDB statements that state each catalogue query independently, over the same tables.

Common table expressions are written once and pulled in by name, each after those it needs.
"""

from __future__ import annotations

from accessloom.sources import fixtures as fx


def _list(words: list[str]) -> str:
    return "[" + ",".join(f"'{w}'" for w in words) + "]"


def _nk(k: str) -> str:
    return f"(CASE WHEN {k}%101=100 THEN {k}-1 ELSE {k} END)"


def _first(k: str) -> str:
    return f"({_list(fx.FIRST_NAMES)})[{_nk(k)}%40+1]"


def _last(k: str) -> str:
    return f"(({_list(fx.LAST_STARTS)})[({_nk(k)}//40)%20+1] || ({_list(fx.LAST_ENDS)})[({_nk(k)}//800)%20+1])"


def _written(k: str) -> str:
    return f"(CASE WHEN {_first(k)}='Zoe' AND ({k}//40)%2=0 THEN 'Zoë' ELSE {_first(k)} END)"


def _full(k: str) -> str:
    return f"({_written(k)} || ' ' || {_last(k)})"


def _handle(k: str) -> str:
    return f"lower({_first(k)} || '.' || {_last(k)})"


def _eid(n: str) -> str:
    return f"('E' || lpad(({n})::VARCHAR, greatest(5, length(({n})::VARCHAR))::INTEGER, '0'))"


def _norm(name: str) -> str:
    return f"trim(regexp_replace(strip_accents(lower({name})), '[^a-z0-9]+', ' ', 'g'))"


def _lcs(a: str, b: str) -> str:
    """New row cell j = max(old[j], max over i<=j with b[i]=ch of old[i-1]+1)."""
    return f"""list_reduce(list_transform(range(1, length({a})+1), lambda p: [ascii(substr({a}, p::INT, 1))]),
      lambda r, ch: list_transform(range(0, length({b})+1), lambda j: CASE WHEN j=0 THEN 0 ELSE greatest(r[j+1],
        list_max(list_transform(range(1, j+1), lambda i: CASE WHEN ascii(substr({b}, i::INT, 1))=ch[1] THEN r[i]+1 ELSE 0 END))) END),
      list_transform(range(0, length({b})+1), lambda z: 0))[length({b})+1]"""


def _near(a: str, b: str) -> str:
    return f"levenshtein({a},{b}) <= (length({a})+length({b}))//10"


def _ratio(a: str, b: str) -> str:
    """Indel distance equals Levenshtein when only one side loses characters; one substitution costs 2."""
    total = f"length({a})+length({b})"
    distance = f"""CASE WHEN levenshtein({a},{b})=abs(length({a})-length({b})) THEN levenshtein({a},{b})
      WHEN length({a})=length({b}) AND levenshtein({a},{b})=1 THEN 2 ELSE {total}-2*{_lcs(a, b)} END"""
    return f"(100 * (1.0 - ({distance})::DOUBLE / ({total})))"


AS_OF = "TIMESTAMP '2001-12-31 00:00:00'"
RUNS_AS_OF = "TIMESTAMP '2024-01-31 00:00:00'"
APPS = _list(fx.APPLICATIONS)
SOURCES = _list(fx.SOURCES)
TYPES = _list(fx.PART_TYPES)

# name -> (columns-free body, names it needs)
CTES: dict[str, tuple[str, tuple[str, ...]]] = {
    "identity": (f"""SELECT c_custkey AS identity_id, {_full('c_custkey')} AS name,
        {_handle('c_custkey')} || '@corp.example' AS email, n_name AS department, c_mktsegment AS title, r_name AS location,
        CASE WHEN c_custkey<>0 AND c_custkey%40<>7 THEN (c_custkey-1)//8 END AS manager_id,
        CASE WHEN c_acctbal<0 THEN 'terminated' ELSE 'active' END AS lifecycle_status,
        CASE WHEN c_acctbal<0 THEN DATE '2001-12-31' - (c_custkey%700+1)::INT END AS termination_date
      FROM customer JOIN nation ON c_nationkey=n_nationkey JOIN region ON n_regionkey=r_regionkey""", ()),
    "application": (f"""SELECT unnest({APPS}) AS application,
        unnest(['crown_jewel','high','standard','standard','standard']) AS criticality,
        unnest({SOURCES}[1:5]) AS source_system""", ()),
    "account": ("""SELECT o_orderkey AS account_id, o_orderpriority AS application,
        'user' || o_orderkey || CASE WHEN o_orderkey%3=0 THEN '@corp.onmicrosoft.com' ELSE '@corp.example' END AS username,
        o_orderstatus<>'F' AS enabled, CASE WHEN o_orderkey%13<>0 THEN o_orderdate END AS last_activity_at,
        CASE WHEN o_orderkey%17 NOT IN (0,1) THEN o_custkey END AS owner_id,
        CASE o_orderkey%17 WHEN 0 THEN 'orphan' WHEN 1 THEN 'unresolved' WHEN 2 THEN 'service_owned' ELSE 'owned' END AS ownership_status,
        CASE WHEN o_orderkey%17 IN (1,2) THEN 'service' ELSE 'human' END AS account_type FROM orders""", ()),
    "entitlement": (f"""SELECT 'part:'||p_partkey AS entitlement_id, p_name||' #'||p_partkey AS name, 'role' AS type,
        p_size>=48 AS privileged, ({APPS})[p_partkey%5+1] AS application FROM part
      UNION ALL SELECT DISTINCT 'brand:'||p_brand, p_brand, 'group', false,
        ({APPS})[split_part(p_brand,'#',2)::BIGINT%5+1] FROM part
      UNION ALL SELECT DISTINCT 'type:'||p_type, p_type, 'group', p_type='PROMO',
        ({APPS})[(list_position({TYPES}, p_type)-1)%5+1] FROM part""", ()),
    "links": ("""SELECT DISTINCT l_orderkey AS account_id, 'part:'||l_partkey AS entitlement_id FROM lineitem
      UNION SELECT l_orderkey, 'brand:'||p_brand FROM lineitem JOIN part ON l_partkey=p_partkey""", ()),
    "edge": (f"""SELECT 'part:'||p_partkey AS child_id, 'type:'||p_type AS parent_id FROM part WHERE p_partkey%7=0
      UNION ALL SELECT 'part:'||p_partkey, 'part:'||(p_partkey//4) FROM part WHERE p_partkey>0 AND p_partkey%5=0
      UNION ALL SELECT 'type:'||t, 'type:'||({TYPES})[list_position({TYPES}, t)%6+1]
        FROM (SELECT DISTINCT p_type AS t FROM part)""", ()),
    "priv": ("""SELECT DISTINCT account_id, true AS p FROM links JOIN entitlement USING (entitlement_id) WHERE privileged""",
             ("links", "entitlement")),
    "fact": ("""SELECT a.*, p.p IS NOT NULL AS privileged, ap.criticality, i.name AS owner_name,
        i.lifecycle_status AS owner_status, i.termination_date FROM account a LEFT JOIN priv p USING (account_id)
        LEFT JOIN application ap ON a.application=ap.application LEFT JOIN identity i ON a.owner_id=i.identity_id""",
             ("account", "priv", "application", "identity")),
    "f_term": ("""SELECT 'TERMINATED_WITH_ACTIVE_ACCESS' AS rule_code, 'account' AS subject_type, account_id::VARCHAR AS subject_id,
        5 AS base_points, CASE WHEN privileged THEN 3 ELSE 0 END AS privileged_points,
        CASE WHEN criticality='crown_jewel' THEN 1 ELSE 0 END AS context_points,
        CASE WHEN DATE '2001-12-31'-termination_date>30 THEN 1 ELSE 0 END AS extra_points,
        owner_name||' was terminated on '||termination_date||' ('||(DATE '2001-12-31'-termination_date)||' days ago) but account '
        ||username||' in '||application||' is enabled'||CASE WHEN privileged THEN ' with privileged access' ELSE '' END||'.' AS explanation
      FROM fact WHERE owner_status='terminated' AND enabled""", ("fact",)),
    "f_orph": ("""SELECT 'ORPHANED_ACCOUNT' AS rule_code, 'account' AS subject_type, account_id::VARCHAR AS subject_id,
        4 AS base_points, CASE WHEN privileged THEN 2 ELSE 0 END AS privileged_points,
        CASE WHEN enabled THEN 2 ELSE 0 END AS context_points, 1 AS extra_points,
        'Account '||username||' in '||application||' has no known owner or purpose.' AS explanation
      FROM fact WHERE ownership_status='orphan'""", ("fact",)),
    "f_dorm": (f"""SELECT 'DORMANT_ACCOUNT' AS rule_code, 'account' AS subject_type, account_id::VARCHAR AS subject_id,
        3 AS base_points, CASE WHEN privileged THEN 2 ELSE 0 END AS privileged_points, 2 AS context_points,
        CASE WHEN owner_id IS NULL THEN 2 ELSE 0 END AS extra_points,
        'Account '||username||' in '||application||' was idle for '||date_sub('day', last_activity_at, {AS_OF})
        ||' days (threshold: 180).' AS explanation
      FROM fact WHERE enabled AND date_sub('day', last_activity_at, {AS_OF})>=180""", ("fact",)),
    "f_nhi": ("""SELECT 'UNOWNED_NON_HUMAN_IDENTITY' AS rule_code, 'account' AS subject_type, account_id::VARCHAR AS subject_id,
        4 AS base_points, CASE WHEN privileged THEN 2 ELSE 0 END AS privileged_points, 2 AS context_points,
        CASE WHEN owner_status='terminated' THEN 2 ELSE 0 END AS extra_points,
        'Non-human account '||username||' in '||application||' has no accountable owner ('||
        CASE WHEN owner_status='terminated' THEN 'set up by '||owner_name||', since terminated' ELSE 'no owner on record' END||').' AS explanation
      FROM fact WHERE account_type IN ('service','unknown')
        AND NOT (owner_status IS NOT NULL AND owner_status<>'terminated' AND ownership_status<>'unresolved')""", ("fact",)),
    "outlier": ("""SELECT i.identity_id::VARCHAR AS subject_id, h.entitlement_id, c.n AS holders_in_cohort, s.n AS cohort_size,
        c.n/s.n AS prevalence, i.name||' ('||i.title||', '||i.department||') holds '''||e.name||''', held by only '||c.n||' of '
        ||s.n||' peers ('||round_even(c.n/s.n*100,0)::INT||'%).' AS explanation
      FROM (SELECT DISTINCT owner_id, entitlement_id FROM links JOIN account USING (account_id)
            JOIN entitlement USING (entitlement_id) WHERE privileged AND owner_id IS NOT NULL) h
      JOIN identity i ON i.identity_id=h.owner_id AND i.lifecycle_status='active'
      JOIN (SELECT department, title, count(*) n FROM identity WHERE lifecycle_status='active' GROUP BY ALL) s
        ON s.department=i.department AND s.title=i.title AND s.n>=8
      JOIN (SELECT department, title, entitlement_id, count(DISTINCT owner_id) n FROM links JOIN account USING (account_id)
            JOIN identity ON owner_id=identity_id WHERE lifecycle_status='active' GROUP BY ALL) c
        ON c.department=i.department AND c.title=i.title AND c.entitlement_id=h.entitlement_id
      JOIN entitlement e ON e.entitlement_id=h.entitlement_id WHERE c.n/s.n<=0.10""",
                ("links", "account", "entitlement", "identity")),
    "f_out": ("""SELECT 'PRIVILEGED_PEER_OUTLIER' AS rule_code, 'identity' AS subject_type, subject_id, 3 AS base_points,
        3 AS privileged_points, 2 AS context_points, 1 AS extra_points, explanation FROM (
        SELECT *, row_number() OVER (PARTITION BY subject_id ORDER BY prevalence, entitlement_id) rn FROM outlier) WHERE rn=1""",
              ("outlier",)),
    "f_sod": ("""SELECT 'SOD_CONFLICT' AS rule_code, 'identity' AS subject_type, identity_id::VARCHAR AS subject_id, 5 AS base_points,
        1 AS privileged_points, CASE WHEN lifecycle_status='active' THEN 2 ELSE 0 END AS context_points, 2 AS extra_points,
        name||' holds both sides of a separation-of-duties conflict: cold widget with small ring.' AS explanation
      FROM identity JOIN (SELECT identity_id FROM sod_side GROUP BY identity_id HAVING bool_or(cold) AND bool_or(small)) USING (identity_id)""",
              ("identity", "sod_side")),
    "sod_side": ("""SELECT owner_id AS identity_id, name ILIKE '%cold widget%' AS cold, name ILIKE '%small ring%' AS small
      FROM (SELECT entitlement_id, name FROM entitlement WHERE name ILIKE '%cold widget%' OR name ILIKE '%small ring%')
      JOIN links USING (entitlement_id) JOIN account USING (account_id) WHERE owner_id IS NOT NULL""", ("entitlement", "links", "account")),
    "f_mgr": ("""SELECT 'MISSING_MANAGER' AS rule_code, 'identity' AS subject_type, identity_id::VARCHAR AS subject_id, 3 AS base_points,
        CASE WHEN strong.owner_id IS NOT NULL THEN 2 ELSE 0 END AS privileged_points, 0 AS context_points, 0 AS extra_points,
        name||' has no manager on record; reviews fall back to the IAM queue.' AS explanation
      FROM identity LEFT JOIN (SELECT DISTINCT owner_id FROM account JOIN priv USING (account_id)) strong ON strong.owner_id=identity_id
      WHERE lifecycle_status='active' AND manager_id IS NULL AND department<>'NATION_0'""",
              ("identity", "account", "priv")),
    "raw_finding": ("""SELECT * FROM f_term UNION ALL SELECT * FROM f_orph UNION ALL SELECT * FROM f_dorm UNION ALL SELECT * FROM f_nhi
        UNION ALL SELECT * FROM f_out UNION ALL SELECT * FROM f_sod UNION ALL SELECT * FROM f_mgr""",
                    ("f_term", "f_orph", "f_dorm", "f_nhi", "f_out", "f_sod", "f_mgr")),
    "disposition": ("""SELECT 'TERMINATED_WITH_ACTIVE_ACCESS:account:'||o_orderkey AS finding_key,
        CASE WHEN o_orderkey%2=0 THEN 'accept' ELSE 'suppress' END AS action, DATE '2001-12-31'-(o_orderkey%90)::INT AS created,
        CASE o_orderkey%3 WHEN 1 THEN DATE '2001-12-30' WHEN 2 THEN DATE '2002-01-30' END AS expires FROM orders WHERE o_orderkey%23=0
      UNION ALL SELECT 'TERMINATED_WITH_ACTIVE_ACCESS:account:'||o_orderkey, 'accept', DATE '2001-12-31', DATE '2001-12-31'
        FROM orders WHERE o_orderkey%92=0""", ()),
    "valid_disposition": ("""SELECT finding_key, action FROM (SELECT *, row_number() OVER (PARTITION BY finding_key ORDER BY created DESC,
        expires NULLS LAST) rn FROM disposition) WHERE rn=1 AND (expires IS NULL OR expires>DATE '2001-12-31')""", ("disposition",)),
    "finding": ("""SELECT rule_code||':'||subject_type||':'||subject_id AS finding_key, r.*,
        least(base_points+privileged_points+context_points+extra_points, 10)::INT AS risk_score,
        CASE WHEN d.action='accept' THEN 'accepted' WHEN d.action IS NOT NULL THEN 'suppressed' ELSE 'open' END AS status
      FROM raw_finding r LEFT JOIN valid_disposition d ON d.finding_key=rule_code||':'||subject_type||':'||subject_id""",
                ("raw_finding", "valid_disposition")),
    "held": ("""SELECT owner_id AS identity_id, entitlement_id, min(account_id) AS account_id FROM links JOIN account USING (account_id)
        WHERE owner_id IS NOT NULL GROUP BY ALL""", ("links", "account")),
    "right_": ("""SELECT me.identity_id, c.entitlement_id, (c.n - CASE WHEN me.lifecycle_status='active' AND own.identity_id IS NOT NULL
          THEN 1 ELSE 0 END) / (s.n - CASE WHEN me.lifecycle_status='active' THEN 1 ELSE 0 END) AS prevalence
      FROM identity me JOIN cohort s ON s.department=me.department AND s.title=me.title
      JOIN cohort_held c ON c.department=me.department AND c.title=me.title
      LEFT JOIN held own ON own.identity_id=me.identity_id AND own.entitlement_id=c.entitlement_id
      WHERE s.n - CASE WHEN me.lifecycle_status='active' THEN 1 ELSE 0 END >= 3
        AND (c.n - CASE WHEN me.lifecycle_status='active' AND own.identity_id IS NOT NULL THEN 1 ELSE 0 END)
          / (s.n - CASE WHEN me.lifecycle_status='active' THEN 1 ELSE 0 END) >= 0.6""", ("identity", "held", "cohort", "cohort_held")),
    "cohort": ("SELECT department, title, count(*) n FROM identity WHERE lifecycle_status='active' GROUP BY ALL", ("identity",)),
    "cohort_held": ("""SELECT c.department, c.title, entitlement_id, h.n FROM cohort c JOIN (SELECT department, title, entitlement_id, count(*) n
        FROM held JOIN identity USING (identity_id) WHERE lifecycle_status='active' GROUP BY ALL) h
        ON h.department=c.department AND h.title=c.title AND h.n >= 0.6*(c.n-1)""", ("cohort", "held", "identity")),
    "leaver_step": ("""SELECT i.identity_id, a.account_id, a.enabled, a.account_type, a.username, a.account_id%11<>0 AS ok,
        'leaver:'||i.identity_id||':hr-'||i.identity_id AS idempotency_key,
        'disable_'||CASE WHEN a.username LIKE '%onmicrosoft.com%' THEN 'cloud' ELSE 'directory' END||':'||a.account_id AS step_name
      FROM identity i JOIN account a ON a.owner_id=i.identity_id WHERE i.lifecycle_status='terminated'""", ("identity", "account")),
    "route": ("""SELECT identity_id, reviewer_id, CASE WHEN reviewer_id IS NULL THEN 'iam_fallback_queue'
          WHEN depth=1 THEN 'direct_manager' ELSE 'nearest_active_manager' END AS reviewer_route FROM (
        SELECT i.identity_id, arg_min(c.manager, c.depth) AS reviewer_id, min(c.depth) AS depth FROM identity i
        LEFT JOIN (SELECT climb.identity_id, manager, depth FROM climb JOIN identity m ON m.identity_id=manager
                   WHERE m.lifecycle_status='active') c ON c.identity_id=i.identity_id GROUP BY i.identity_id)""", ("identity", "climb")),
    "climb": ("""SELECT identity_id, manager_id AS manager, 1 AS depth FROM identity WHERE manager_id IS NOT NULL
      UNION ALL SELECT c.identity_id, m.manager_id, depth+1 FROM climb c JOIN identity m ON m.identity_id=c.manager
        WHERE m.manager_id IS NOT NULL AND depth<10""", ("identity",)),
    "walk": ("""SELECT entitlement_id AS root_id, entitlement_id AS node_id, 0 AS depth, [entitlement_id] AS path, [name] AS names FROM entitlement
      UNION ALL SELECT w.root_id, e.parent_id, depth+1, list_append(path, e.parent_id), list_append(names, n.name)
        FROM walk w JOIN (SELECT DISTINCT * FROM edge) e ON e.child_id=w.node_id JOIN entitlement n ON n.entitlement_id=e.parent_id
        WHERE depth<10 AND NOT list_contains(path, e.parent_id)""", ("entitlement", "edge")),
    "closure": ("""SELECT root_id, node_id, depth, path, names FROM (SELECT *, row_number() OVER (PARTITION BY root_id, node_id
        ORDER BY depth, path) rn FROM walk) WHERE rn=1""", ("walk",)),
    "access": ("""SELECT a.owner_id AS identity_id, a.account_id, a.application, c.root_id AS granted_id, c.node_id AS entitlement_id,
        e.name AS entitlement_name, e.type AS entitlement_type, e.privileged::INT AS privileged,
        CASE WHEN depth=0 THEN 'direct' ELSE 'inherited' END AS grant_type, depth, array_to_string(names,' -> ') AS path
      FROM links l JOIN account a USING (account_id) JOIN closure c ON c.root_id=l.entitlement_id
      JOIN entitlement e ON e.entitlement_id=c.node_id WHERE a.owner_id IS NOT NULL""", ("links", "account", "closure", "entitlement")),
    "item": ("""SELECT a.account_id, l.entitlement_id, a.owner_id AS identity_id, r.reviewer_id, r.reviewer_route
      FROM account a JOIN links l USING (account_id) JOIN route r ON r.identity_id=a.owner_id WHERE a.application='1-URGENT'""",
             ("account", "links", "route")),
    "decided": ("""SELECT *, (account_id+coalesce(try_cast(regexp_extract(entitlement_id,'([0-9]+)$',1) AS BIGINT),0))%5 AS s,
        CASE s WHEN 1 THEN 'revoke' WHEN 3 THEN 'approve' WHEN 4 THEN 'delegate' END AS decision FROM item""", ("item",)),
    "roster_raw": (f"""SELECT k+2 AS source_line, n, k, CASE k%5 WHEN 0 THEN {_eid('n')}
          WHEN 1 THEN 'E'||lpad(n::VARCHAR, greatest(4,length(n::VARCHAR))::INT, '0') WHEN 2 THEN 'E'||n WHEN 3 THEN n::VARCHAR
          ELSE {_eid('n')}||'  ' END AS employee_id, {_full('k')} AS full_name,
        {_handle('k')}||'@'||CASE WHEN k%194=193 THEN 'acquired.example' ELSE 'corp.example' END AS work_email,
        CASE WHEN k=0 OR k%40=7 THEN '' WHEN k%211=5 THEN 'E9999999' ELSE {_eid('((k-1)//8+1)')} END AS manager_employee_id,
        n_name AS department, c_mktsegment AS title,
        CASE WHEN k%50=49 THEN 'unknown' WHEN k%3=0 THEN strftime(DATE '1990-01-01'+(k%4000)::INT,'%Y-%m-%d')
          WHEN k%3=1 THEN strftime(DATE '1990-01-01'+(k%4000)::INT,'%m/%d/%Y')
          ELSE ((DATE '1990-01-01'+(k%4000)::INT)-DATE '1899-12-30')::VARCHAR END AS hire_text,
        CASE WHEN c_acctbal<0 THEN DATE '2001-12-31'-(k%700+1)::INT END AS termination_date,
        CASE WHEN c_acctbal<0 AND k%2=1 THEN 'Terminated' ELSE 'Active' END AS status, k%251=250 AS malformed
      FROM (SELECT *, c_custkey AS k, CASE WHEN c_custkey%97=96 THEN c_custkey ELSE c_custkey+1 END AS n FROM customer)
      JOIN nation ON c_nationkey=n_nationkey""", ()),
    "parsed": (f"""SELECT source_line, full_name AS name, department, title, lower(trim(work_email)) AS email,
        split_part(lower(work_email),'@',1) AS email_localpart, split_part(work_email,'@',2) AS domain,
        {_norm('full_name')} AS norm_name,
        'E'||lpad(ltrim(regexp_replace(employee_id,'[^0-9]','','g'),'0'),
            greatest(5,length(ltrim(regexp_replace(employee_id,'[^0-9]','','g'),'0')))::INT,'0') AS norm_id,
        CASE WHEN regexp_full_match(hire_text,'[0-9]{{5}}') THEN DATE '1899-12-30'+try_cast(hire_text AS INT)
          WHEN hire_text LIKE '%-%' THEN try_strptime(hire_text,'%Y-%m-%d')::DATE
          WHEN hire_text LIKE '%/%' THEN try_strptime(hire_text,'%m/%d/%Y')::DATE END AS hire_date, hire_text,
        termination_date, CASE WHEN termination_date IS NOT NULL OR status='Terminated' THEN 'terminated' ELSE 'active' END AS lifecycle_status,
        termination_date IS NOT NULL AND status='Active' AS conflict,
        CASE WHEN manager_employee_id<>'' THEN 'E'||lpad(ltrim(substr(manager_employee_id,2),'0'),
            greatest(5,length(ltrim(substr(manager_employee_id,2),'0')))::INT,'0') END AS manager_norm
      FROM roster_raw WHERE NOT malformed""", ("roster_raw",)),
    "collision": ("""SELECT p.norm_id, source_line, email, norm_name, g.group_size, g.emails, g.names,
        g.emails=g.group_size AND g.names=g.group_size AND corp AS resolvable,
        row_number() OVER (PARTITION BY p.norm_id ORDER BY source_line)-1 AS group_index
      FROM parsed p JOIN (SELECT norm_id, count(*) AS group_size, count(DISTINCT email) AS emails, count(DISTINCT norm_name) AS names,
          bool_and(domain='corp.example') AS corp FROM parsed GROUP BY norm_id HAVING count(*)>1) g ON g.norm_id=p.norm_id""", ("parsed",)),
    "built": ("""SELECT p.*, c.group_size, c.resolvable, c.group_index,
        CASE WHEN c.group_size IS NULL THEN p.norm_id WHEN c.resolvable THEN
          p.norm_id||CASE WHEN c.group_index>0 THEN '-DUP'||c.group_index ELSE '' END END AS canonical
      FROM parsed p LEFT JOIN collision c USING (source_line)""", ("parsed", "collision")),
    "record": ("""SELECT b.source_line, b.canonical AS canonical_employee_id, b.norm_id, b.name, b.norm_name, b.email, b.email_localpart,
        b.department, hire_date, CASE WHEN hire_date IS NULL THEN 'UNPARSEABLE_DATE:'||hire_text END AS hire_date_error, termination_date,
        lifecycle_status, b.group_index, CASE WHEN b.canonical IS NOT NULL THEN m.canonical END AS manager_employee_id,
        CASE WHEN group_size IS NULL THEN 'normalized' ELSE 'quarantined' END AS stage,
        CASE WHEN group_size IS NOT NULL AND NOT resolvable THEN 'EMPLOYEE_ID_COLLISION_UNRESOLVED'
          WHEN group_size IS NOT NULL THEN 'EMPLOYEE_ID_COLLISION_RESOLVED' WHEN conflict THEN 'SOURCE_STATUS_DATE_CONFLICT'
          WHEN manager_norm IS NULL THEN 'MISSING_MANAGER' WHEN m.canonical IS NULL THEN 'MANAGER_NOT_FOUND_IN_BATCH'
          WHEN m.status='terminated' THEN 'MANAGER_TERMINATED' ELSE 'OK' END AS reason_code,
        CASE WHEN group_size IS NULL THEN NULL WHEN resolvable THEN 'resolved' ELSE 'open' END AS quarantine_status,
        conflict::INT AS status_date_conflict
      FROM built b LEFT JOIN (SELECT norm_id, arg_max(canonical, source_line) AS canonical, arg_max(lifecycle_status, source_line) AS status
        FROM built WHERE canonical IS NOT NULL GROUP BY norm_id) m ON m.norm_id=b.manager_norm
      UNION ALL BY NAME SELECT source_line, 'quarantined' AS stage, 'MALFORMED_CSV_ROW' AS reason_code, 'open' AS quarantine_status,
        0 AS status_date_conflict FROM roster_raw WHERE malformed""", ("built", "roster_raw")),
    "person": ("""SELECT canonical_employee_id AS identity_id, name, norm_name, email_localpart AS local, department, lifecycle_status, source_line
      FROM record WHERE canonical_employee_id IS NOT NULL""", ("record",)),
    "local_holder": ("""SELECT local, count(*) AS holders, min(identity_id) AS holder_id FROM person GROUP BY local""", ("person",)),
    "cloud_raw": (f"""SELECT k+2 AS source_line, 'cloud-'||k AS native_id,
        CASE WHEN k%61=60 THEN 'x'||k ELSE {_handle('k')} END AS local, true AS corporate,
        CASE WHEN k%41=40 THEN 'Ms. '||{_last('k')} WHEN k%43=42 THEN substr({_full('k')},1,length({_full('k')})-1) ELSE {_full('k')} END AS shown,
        CASE WHEN k%12=11 THEN 1 ELSE (k%6<>5)::INT END AS enabled,
        CASE WHEN k%7<>3 AND k%61<>60 THEN {_eid('(k+1)')} END AS employee_id,
        CASE WHEN k%20<>0 THEN strftime(DATE '2001-12-31'-(k%900)::INT,'%Y-%m-%d')||' 08:30:00' END AS last_activity
      FROM (SELECT c_custkey AS k FROM customer)""", ()),
    "dir_raw": (f"""SELECT o+2 AS source_line, sam, CASE WHEN o%16=5 THEN 'alt'||o ELSE lower(sam) END AS local, true AS corporate,
        CASE WHEN o%19=0 OR o%17 IN (0,1,2) THEN 'Acct '||o ELSE {_full('w')} END AS shown, NULL::VARCHAR AS employee_id,
        CASE WHEN o%19=0 AND o%38=0 THEN '' WHEN o%19=0 THEN 'Contractor engagement'
          WHEN o%17=2 THEN 'Service integration for '||{_full('w')} WHEN o%17=1 THEN 'CI runner' WHEN o%17=0 THEN '' ELSE 'Employee' END AS description,
        o%19=0 AS in_contractor_unit,
        CASE WHEN o%13=0 OR o%101=0 THEN NULL ELSE strftime(o_orderdate,'%Y-%m-%d %H:%M:%S') END AS last_activity,
        'All-Employees;Group-'||(o%25)||';'||CASE WHEN o%5=0 THEN 'Plant-Ops-Leads;' ELSE '' END AS member_of,
        (CASE WHEN o%16=5 THEN 'alt'||o ELSE sam END)||'@corp.example' AS upn
      FROM (SELECT *, CASE WHEN o%19=0 THEN 'C-'||o WHEN o%17 IN (1,2) THEN 'svc-'||o WHEN o%17=0 THEN 'ghost'||o
          ELSE {_handle('w')} END AS sam FROM (SELECT o_orderkey AS o, o_custkey AS w, o_orderdate FROM orders))""", ()),
    "crm_raw": (f"""SELECT o+2 AS source_line, 'crm'||o AS native_id, CASE WHEN o%29=0 THEN 'q'||o ELSE {_handle('w')} END AS local,
        o%16<>0 AS corporate, CASE WHEN o%23=0 THEN 'Ms. '||{_last('w')} ELSE {_full('w')} END AS shown, NULL::VARCHAR AS employee_id,
        (o%9<>0)::INT AS enabled,
        (['System Administrator','Sales Admin','Sales User','Read Only'])[(o//5)%4+1] AS profile,
        (['','Revenue_Admin|Data_Export','Opportunity_Approver|'])[o%3+1] AS permission_sets
      FROM (SELECT o_orderkey AS o, o_custkey AS w FROM orders)""", ()),
    "iam_raw": (f"""SELECT k, CASE WHEN k%9=0 THEN 'automation-'||k ELSE {_handle('k')} END AS username,
        'arn:aws:iam::000000000000:user/'||k AS native_id, CASE k%3 WHEN 0 THEN 0 WHEN 1 THEN (k*37+11)%900
          ELSE greatest((k*37+11)%900,(k*37+22)%900) END::INT AS oldest_key_days
      FROM (SELECT DISTINCT o_custkey AS k FROM orders)""", ()),
    "iam": ("""SELECT native_id, username, CASE WHEN h.holders=1 THEN h.holder_id END AS owner_identity_id,
        CASE WHEN h.holders=1 THEN 'human' ELSE 'unknown' END AS account_type, oldest_key_days, coalesce(h.holders,0) AS holders,
        CASE WHEN h.holders=1 THEN 'normalized' ELSE 'quarantined' END AS stage,
        CASE WHEN h.holders=1 THEN 'OK' WHEN h.holders>1 THEN 'CORRELATION_AMBIGUOUS' ELSE 'UNOWNED_NON_HUMAN_IDENTITY' END AS reason_code
      FROM iam_raw LEFT JOIN local_holder h ON h.local=username""", ("iam_raw", "local_holder")),
    "dir_stage": ("""SELECT reason_code, CASE WHEN reason_code IN ('CORRELATION_AMBIGUOUS','UNOWNED_SERVICE_ACCOUNT','ORPHANED_DIRECTORY_ACCOUNT')
          THEN 'quarantined' ELSE 'normalized' END AS stage FROM dir""", ("dir",)),
    "crm_record": ("""SELECT r.source_line, native_id, decision, best_score, CASE WHEN decision='auto_match' THEN best_id END AS owner_identity_id,
        CASE WHEN decision='auto_match' THEN 'owned' ELSE 'unresolved' END AS ownership_status, enabled,
        CASE WHEN decision='auto_match' THEN 'normalized' ELSE 'quarantined' END AS stage,
        CASE WHEN decision='auto_match' THEN 'OK' WHEN NOT corporate THEN 'CORRELATION_LEGACY_DOMAIN'
          WHEN decision='quarantine' THEN 'CORRELATION_AMBIGUOUS' ELSE 'NO_IDENTITY_MATCH' END AS reason_code
      FROM crm_raw r JOIN scored_crm s ON s.source_line=r.source_line""", ("crm_raw", "scored_crm")),
    "sheet_record": ("""SELECT s.sheet, s.source_line, s.raw_name, s.role, r.identity_id, r.match_rule,
        CASE WHEN NOT is_primary THEN 'STALE_WORKSHEET_EXCLUDED' WHEN r.identity_id IS NULL THEN 'NAME_MATCH_AMBIGUOUS'
          WHEN r.match_rule<>'email_localpart_exact' AND p.department<>'NATION_1' THEN 'NAME_MATCH_MISSING_ROLE_CONTEXT' ELSE 'OK' END AS reason_code,
        CASE WHEN reason_code='OK' THEN 'normalized' ELSE 'quarantined' END AS stage
      FROM sheet_row s LEFT JOIN resolved r ON s.is_primary AND r.raw_name=s.raw_name LEFT JOIN person p ON p.identity_id=r.identity_id""",
                     ("sheet_row", "resolved", "person")),
    "dir": ("""SELECT d.*, s.decision, CASE WHEN decision='auto_match' THEN 'human' WHEN kind='service' THEN 'service' ELSE 'human' END AS account_type,
        CASE WHEN decision='auto_match' THEN best_id WHEN holders=1 THEN holder_id WHEN kind='contractor' THEN 'contractor:'||lower(sam)
          WHEN kind='service' THEN mentioned END AS owner_identity_id,
        CASE WHEN decision='auto_match' OR holders=1 THEN 'owned' WHEN kind='contractor' THEN 'contractor'
          WHEN kind='service' AND mentioned_status='terminated' THEN 'service_owned_by_terminated'
          WHEN kind='service' AND mentioned IS NOT NULL THEN 'service_owned' WHEN kind='orphan' THEN 'orphan' ELSE 'unresolved' END AS ownership_status,
        CASE WHEN decision='auto_match' THEN 'OK' WHEN holders=1 THEN 'OK_SAM_MATCH' WHEN kind IS NULL THEN 'CORRELATION_AMBIGUOUS'
          WHEN kind='contractor' THEN 'CONTRACTOR_CLASSIFIED' WHEN kind='service' AND mentioned IS NOT NULL THEN 'SERVICE_ACCOUNT_OWNER_RESOLVED'
          WHEN kind='service' THEN 'UNOWNED_SERVICE_ACCOUNT' ELSE 'ORPHANED_DIRECTORY_ACCOUNT' END AS reason_code
      FROM (SELECT r.*, h.holders, h.holder_id, x.decision AS dec, m.mentioned, m.mentioned_status,
          CASE WHEN x.decision<>'auto_match' AND coalesce(h.holders,0)=0 AND x.decision='unmatched' THEN
            CASE WHEN lower(description) LIKE '%contractor%' OR in_contractor_unit THEN 'contractor'
              WHEN lower(sam) LIKE 'svc-%' OR lower(sam) LIKE 'plant-shared-%' OR lower(description) LIKE '%service%' OR lower(description) LIKE '%ci%'
                OR lower(description) LIKE '%automation%' OR lower(description) LIKE '%integration%' THEN 'service' ELSE 'orphan' END END AS kind
        FROM dir_raw r LEFT JOIN local_holder h ON h.local=lower(sam) JOIN scored x ON x.source_line=r.source_line
        LEFT JOIN mention m ON m.text=r.description) d JOIN scored s ON s.source_line=d.source_line""",
            ("dir_raw", "local_holder", "scored", "mention")),
    "mention": ("""SELECT text, min(identity_id) AS mentioned, arg_min(lifecycle_status, identity_id) AS mentioned_status
      FROM (SELECT DISTINCT description AS text FROM dir_raw WHERE description<>'') JOIN person ON contains(lower(text), lower(name))
      GROUP BY text""", ("dir_raw", "person")),
    "cell": (f"""SELECT 'Access list' AS sheet, k+5 AS row_, unnest([1,2,3,4]) AS col, unnest([
          CASE k%3 WHEN 0 THEN CASE WHEN k%41=40 THEN substr({_last('k')},1,length({_last('k')})-1) ELSE {_last('k')} END||', '||{_written('k')}
            WHEN 1 THEN {_first('k')}||' '||substr({_last('k')},1,1)||'.' ELSE {_handle('k')}||'@' END,
          CASE WHEN k%25=0 THEN 'Plant-Ops-Leads' ELSE 'Operator-'||(k%4) END, 'Plant desk',
          CASE k%3 WHEN 0 THEN strftime(DATE '2001-12-01'+(k%28)::INT,'%Y-%m-%d') WHEN 1 THEN strftime(DATE '2001-12-01'+(k%28)::INT,'%m/%d/%Y')
            ELSE ((DATE '2001-12-01'+(k%28)::INT)-DATE '1899-12-30')::VARCHAR END]) AS value FROM (SELECT c_custkey AS k FROM customer)
      UNION ALL SELECT 'Old extract', k+2, unnest([1,2,3]), unnest([
          CASE k%3 WHEN 0 THEN CASE WHEN k%41=40 THEN substr({_last('k')},1,length({_last('k')})-1) ELSE {_last('k')} END||', '||{_written('k')}
            WHEN 1 THEN {_first('k')}||' '||substr({_last('k')},1,1)||'.' ELSE {_handle('k')}||'@' END,
          CASE WHEN k%25=0 THEN 'Plant-Ops-Leads' ELSE 'Operator-'||(k%4) END, strftime(DATE '2001-06-01'+(k%28)::INT,'%Y-%m-%d')])
        FROM (SELECT c_custkey AS k FROM customer)
      UNION ALL SELECT 'Notes', r_regionkey+2, unnest([1,2]), unnest([r_name,'2002-06-01']) FROM region
      UNION ALL SELECT * FROM (VALUES ('Access list',1,1,'Plant access'),('Access list',2,1,'confidential'),('Access list',4,1,'Employee Name'),
        ('Access list',4,2,' ROLE '),('Access list',4,3,'Granted By'),('Access list',4,4,'Date'),('Old extract',1,1,'employee name'),
        ('Old extract',1,2,'role'),('Old extract',1,3,'date'),('Notes',1,1,'employee name'),('Notes',1,2,'date'))""", ()),
    "header": ("""SELECT sheet, min(row_)::INT AS header_row FROM (SELECT sheet, row_ FROM cell WHERE row_<=10 AND col<=7
        AND lower(trim(value)) IN ('employee name','role','granted by','date') GROUP BY sheet, row_
        HAVING count(DISTINCT lower(trim(value)))>=3) GROUP BY sheet""", ("cell",)),
    "column_": ("""SELECT c.sheet, h.header_row, lower(trim(value)) AS title, max(col) AS col FROM cell c JOIN header h
        ON h.sheet=c.sheet AND h.header_row=c.row_ WHERE lower(trim(value)) IN ('employee name','role','granted by','date') GROUP BY ALL""",
                ("cell", "header")),
    "sheet_date": ("""SELECT h.sheet, h.header_row, max(CASE WHEN regexp_full_match(value,'[0-9]{5}') THEN DATE '1899-12-30'+try_cast(value AS INT)
          WHEN value LIKE '%-%' THEN try_strptime(value,'%Y-%m-%d')::DATE WHEN value LIKE '%/%' THEN try_strptime(value,'%m/%d/%Y')::DATE END) AS max_date
      FROM header h JOIN column_ d ON d.sheet=h.sheet AND d.title='date' JOIN cell c ON c.sheet=h.sheet AND c.col=d.col AND c.row_>h.header_row
      GROUP BY ALL""", ("header", "column_", "cell")),
    "sheet_row": ("""SELECT c.sheet, c.row_ AS source_line, trim(max(value) FILTER (title='employee name')) AS raw_name,
        trim(max(value) FILTER (title='role')) AS role, c.sheet=(SELECT arg_max(sheet, max_date) FROM sheet_date) AS is_primary
      FROM cell c JOIN column_ k ON k.sheet=c.sheet AND k.col=c.col WHERE c.row_>k.header_row GROUP BY c.sheet, c.row_""",
                  ("cell", "column_", "sheet_date")),
    "asked": (f"""SELECT raw_name, CASE WHEN raw_name LIKE '%@' THEN 'handle'
          WHEN regexp_full_match(regexp_replace(raw_name,'[.]+$',''),'\\S+\\s+\\S') THEN 'initial' ELSE 'full' END AS form,
        CASE WHEN contains(raw_name,',') THEN {_norm("split_part(raw_name,',',2)||' '||split_part(raw_name,',',1)")}
          ELSE {_norm('raw_name')} END AS norm,
        array_to_string(list_sort(string_split(norm,' ')),' ') AS sorted_norm
      FROM (SELECT DISTINCT raw_name FROM sheet_row WHERE is_primary)""", ("sheet_row",)),
    "sorted_person": ("""SELECT array_to_string(list_sort(string_split(norm_name,' ')),' ') AS sorted_norm, count(*) AS holders,
        min(identity_id) AS identity_id FROM person GROUP BY 1""", ("person",)),
    "near_pair": (f"""SELECT a.raw_name, a.sorted_norm AS asked_norm, p.sorted_norm, p.holders, p.identity_id
      FROM asked a JOIN sorted_person p ON {_near('a.sorted_norm', 'p.sorted_norm')} WHERE a.form='full'""", ("asked", "sorted_person")),
    "fuzzy_pair": (f"""SELECT raw_name, sorted_norm, holders, identity_id, {_ratio('asked_norm', 'sorted_norm')} AS ratio FROM near_pair""",
                   ("near_pair",)),
    "long_name": (f"""SELECT {_norm("full_name||' '||second")} AS known, {_norm("shown||' '||second")} AS asked
      FROM (SELECT full_name, shown, {_full('((source_line-2)//8)')} AS second FROM roster_raw JOIN cloud_raw USING (source_line))""",
                  ("roster_raw", "cloud_raw")),
    "near_long": (f"""SELECT a.n AS probe_name, b.n AS index_name FROM (SELECT DISTINCT asked AS n FROM long_name) a
      JOIN (SELECT DISTINCT known AS n FROM long_name) b ON {_near('a.n', 'b.n')}""", ("long_name",)),
    "near_name": (f"""SELECT a.n AS probe_name, b.n AS index_name
      FROM (SELECT DISTINCT array_to_string(list_sort(string_split({_norm('shown')},' ')),' ') AS n FROM cloud_raw) a
      JOIN (SELECT DISTINCT array_to_string(list_sort(string_split({_norm('full_name')},' ')),' ') AS n FROM roster_raw) b
      ON {_near('a.n', 'b.n')}""", ("cloud_raw", "roster_raw")),
    "fuzzy_top": ("""SELECT raw_name, identity_id FROM (SELECT *, row_number() OVER (PARTITION BY raw_name ORDER BY ratio DESC, sorted_norm) rn,
        lead(ratio) OVER (PARTITION BY raw_name ORDER BY ratio DESC, sorted_norm) AS next_ratio FROM fuzzy_pair WHERE ratio>=90)
      WHERE rn=1 AND holders=1 AND (next_ratio IS NULL OR ratio-next_ratio>=5)""", ("fuzzy_pair",)),
    "resolved": ("""SELECT raw_name, min(identity_id) AS identity_id, 'email_localpart_exact' AS match_rule FROM asked a JOIN person p
          ON p.norm_name=replace(rtrim(raw_name,'@'),'.',' ') WHERE form='handle' GROUP BY raw_name
      UNION ALL SELECT raw_name, min(identity_id), 'first_lastinitial_exact' FROM asked a JOIN person p
          ON starts_with(p.norm_name, split_part(a.norm,' ',1)||' ') AND starts_with(list_last(string_split(p.norm_name,' ')), split_part(a.norm,' ',2))
          WHERE form='initial' GROUP BY raw_name HAVING count(*)=1
      UNION ALL SELECT raw_name, identity_id, 'fuzzy_name_unique' FROM fuzzy_top""", ("asked", "person", "fuzzy_top")),
    "run": (f"""SELECT source_system||':'||strftime(day,'%Y-%m-%d') AS run_id, source_system, day, max(ts) AS completed_at, count(*) AS rows_in,
        CASE (day(day)+length(source_system))%7 WHEN 0 THEN 'failed' WHEN 3 THEN 'partially_failed' ELSE 'succeeded' END AS status
      FROM (SELECT *, ts::DATE AS day, ({SOURCES})[user_id%6+1] AS source_system FROM events) GROUP BY source_system, day""", ()),
    "run_record": (f"""SELECT ({SOURCES})[user_id%6+1]||':'||strftime(ts,'%Y-%m-%d') AS run_id, ({SOURCES})[user_id%6+1] AS source_system,
        ts::DATE AS day, CASE WHEN event_type='error' THEN 'quarantined' ELSE 'normalized' END AS stage, upper(event_type) AS reason_code
      FROM events""", ()),
    "health": (f"""SELECT s.source_system, l.status AS last_run_status, ok.completed_at, ok.run_id AS watermark_run_id,
        epoch_us({RUNS_AS_OF}-ok.completed_at)/3600000000.0 AS hours,
        CASE WHEN ok.completed_at IS NULL THEN 1 ELSE (epoch_us({RUNS_AS_OF}-ok.completed_at)/3600000000.0>24)::INT END AS stale
      FROM (SELECT unnest({SOURCES}) AS source_system) s LEFT JOIN (SELECT source_system, arg_max(status, day) AS status FROM run GROUP BY 1) l
        USING (source_system) LEFT JOIN (SELECT source_system, max(completed_at) AS completed_at, arg_max(run_id, completed_at) AS run_id FROM run
        WHERE status='succeeded' GROUP BY 1) ok USING (source_system)""", ("run",)),
}


def _scored(feed: str, tag: str = "") -> dict[str, tuple[str, tuple[str, ...]]]:
    """Candidates and decision of an account feed with local, corporate, shown and employee_id."""
    agree = f"""CASE WHEN norm_shown<>'' AND norm_shown=p.norm_name THEN 2 WHEN {_near('norm_shown', 'p.norm_name')}
        AND norm_shown<>'' THEN CASE WHEN {_ratio('norm_shown', 'p.norm_name')}>=90 THEN 1 ELSE 0 END ELSE 0 END"""
    return {
        f"probe{tag}": (f"SELECT *, {_norm('shown')} AS norm_shown FROM {feed}", (feed,)),
        f"candidate{tag}": (f"""SELECT source_line, identity_id, max(base)+CASE max(tier) WHEN 2 THEN 20 WHEN 1 THEN 15 ELSE 0 END AS score,
            arg_max(rule, base)||CASE max(tier) WHEN 2 THEN '+EXACT_NAME' WHEN 1 THEN '+FUZZY_NAME' ELSE '' END AS rule FROM (
            SELECT r.source_line, p.identity_id, 65 AS base, 'EMPLOYEE_ID_MATCH' AS rule, {agree} AS tier
              FROM probe{tag} r JOIN person p ON p.identity_id=r.employee_id
            UNION ALL SELECT r.source_line, p.identity_id, CASE WHEN corporate THEN 60 ELSE 40 END,
              CASE WHEN corporate THEN 'CORPORATE_LOCALPART_MATCH' ELSE 'NONCORPORATE_LOCALPART_MATCH' END, {agree}
              FROM probe{tag} r JOIN person p ON p.local=r.local) GROUP BY source_line, identity_id""", (f"probe{tag}", "person")),
        f"ranked{tag}": (f"""SELECT *, row_number() OVER (PARTITION BY source_line ORDER BY score DESC, identity_id) AS rn
          FROM candidate{tag}""", (f"candidate{tag}",)),
        f"scored{tag}": (f"""SELECT r.source_line, a.score AS best_score, a.identity_id AS best_id, b.score AS runner_up_score,
            CASE WHEN coalesce(a.score,0)<50 THEN 'unmatched' WHEN b.score>=50 AND a.score-b.score<10 THEN 'quarantine'
              WHEN a.score>=80 THEN 'auto_match' ELSE 'quarantine' END AS decision
          FROM {feed} r LEFT JOIN ranked{tag} a ON a.source_line=r.source_line AND a.rn=1
          LEFT JOIN ranked{tag} b ON b.source_line=r.source_line AND b.rn=2""", (feed, f"ranked{tag}")),
    }


# Pair lists are kept as such, so the costly ratio is not evaluated inside the join; what several parts of a statement
# read is made once.
_KEPT = dict.fromkeys(
    ("near_pair", "near_name", "near_long", "identity", "account", "entitlement", "links", "priv", "fact", "held", "holding", "cohort",
     "cohort_held", "sod_side", "outlier", "valid_disposition", "raw_finding"), "MATERIALIZED ")


def _statement(final: str, *needed: str, feed: str | None = None, instead: dict | None = None) -> str:
    ctes = {**CTES, **_scored("cloud_raw", "_cloud"), **_scored("crm_raw", "_crm"), **(_scored(feed) if feed else {}), **(instead or {})}
    order: list[str] = []

    def add(name: str) -> None:
        if name in order:
            return
        for dependency in ctes[name][1]:
            add(dependency)
        order.append(name)

    for name in needed:
        add(name)
    parts = ",\n".join(f"{name} AS {_KEPT.get(name, '')}({ctes[name][0]})" for name in order)
    return f"WITH RECURSIVE {parts}\n{final}" if parts else final


def _rule(cte: str) -> str:
    return _statement(f"""SELECT rule_code, subject_type, subject_id, base_points, privileged_points, context_points, extra_points,
        explanation, risk_score, {SEVERITY} AS severity
      FROM (SELECT *, least(base_points+privileged_points+context_points+extra_points,10)::INT AS risk_score FROM {cte})""", cte)


SEVERITY = "CASE WHEN risk_score>=9 THEN 'critical' WHEN risk_score>=7 THEN 'high' WHEN risk_score>=4 THEN 'medium' ELSE 'low' END"
CLOUD_REASON = """CASE decision WHEN 'auto_match' THEN 'AUTO_MATCHED' WHEN 'quarantine' THEN 'CORRELATION_AMBIGUOUS' ELSE 'NO_IDENTITY_MATCH' END"""

ORACLES: dict[str, str] = {
    "finding_terminated_active": _rule("f_term"),
    "finding_orphaned": _rule("f_orph"),
    "finding_dormant": _rule("f_dorm"),
    "finding_unowned_nhi": _rule("f_nhi"),
    "finding_missing_manager": _rule("f_mgr"),
    "finding_sod": _statement(f"""SELECT rule_code, subject_type, subject_id, base_points, privileged_points, context_points, extra_points,
        explanation, risk_score, {SEVERITY} AS severity, 'cold widget with small ring' AS rule
      FROM (SELECT *, least(base_points+privileged_points+context_points+extra_points,10)::INT AS risk_score FROM f_sod)""", "f_sod"),
    "finding_peer_outlier": _statement("""SELECT subject_id, entitlement_id, 'critical' AS severity, 9 AS risk_score, holders_in_cohort,
        cohort_size, round(prevalence,6) AS prevalence, explanation FROM outlier""", "outlier"),
    "findings_with_disposition": _statement(f"""SELECT finding_key, rule_code, subject_type, subject_id, {SEVERITY} AS severity, risk_score,
        base_points, privileged_points, context_points, extra_points, status FROM finding""", "finding"),
    "findings_top": _statement(f"""SELECT finding_key, risk_score, {SEVERITY} AS severity, explanation FROM finding WHERE status='open'
      ORDER BY risk_score DESC, finding_key LIMIT 20""", "finding"),
    "findings_by_rule": _statement("""SELECT rule_code, count(*) AS findings, count_if(status='open')::BIGINT AS open_findings,
        max(risk_score) AS max_score FROM finding GROUP BY rule_code""", "finding"),
    "disposition_active": _statement("SELECT finding_key, action FROM valid_disposition", "valid_disposition"),
    "standardise_roster": _statement("""SELECT source_line, canonical_employee_id, norm_id, norm_name, email, email_localpart,
        hire_date::VARCHAR AS hire_date, hire_date_error, termination_date::VARCHAR AS termination_date, lifecycle_status, manager_employee_id,
        stage, reason_code, quarantine_status, status_date_conflict FROM record""", "record"),
    "reconcile_roster": _statement("SELECT stage, reason_code, count(*) AS row_count FROM record GROUP BY ALL", "record"),
    "roster_collisions": _statement("""SELECT norm_id, source_line, group_index, group_size, emails, names, resolvable::INT AS resolvable
      FROM collision""", "collision"),
    "manager_link": _statement("""SELECT canonical_employee_id AS identity_id, manager_employee_id AS manager_id, source_line FROM record
      WHERE canonical_employee_id IS NOT NULL""", "record"),
    "roster_aliases": _statement("""SELECT canonical_employee_id AS identity_id, 'employee_id' AS alias_type, canonical_employee_id AS value
        FROM record WHERE canonical_employee_id IS NOT NULL
      UNION SELECT canonical_employee_id, 'email_localpart', email_localpart FROM record WHERE canonical_employee_id IS NOT NULL
      UNION SELECT canonical_employee_id, 'employee_id_disputed', norm_id FROM record WHERE canonical_employee_id IS NOT NULL AND group_index>0""",
                                 "record"),
    "roster_quarantine": _statement("""SELECT source_line, CASE WHEN reason_code='MALFORMED_CSV_ROW' THEN reason_code ELSE 'EMPLOYEE_ID_COLLISION' END
        AS reason_code, quarantine_status AS status, norm_id AS candidate_ids,
        CASE WHEN quarantine_status='resolved' THEN 'system:correlation_policy' END AS resolved_by FROM record WHERE stage='quarantined'""", "record"),
    "status_date_conflict": _statement("""SELECT canonical_employee_id AS identity_id, name, termination_date::VARCHAR AS termination_date,
        lifecycle_status FROM record WHERE status_date_conflict=1 AND canonical_employee_id IS NOT NULL""", "record"),
    "correlate_accounts": _statement(f"""SELECT r.source_line, native_id, decision, best_score, runner_up_score,
        CASE WHEN decision='auto_match' THEN best_id END AS owner_identity_id,
        CASE WHEN decision='auto_match' THEN 'owned' ELSE 'unresolved' END AS ownership_status, enabled, last_activity,
        CASE WHEN decision='auto_match' THEN 'normalized' ELSE 'quarantined' END AS stage, {CLOUD_REASON} AS reason_code,
        CASE WHEN decision<>'auto_match' THEN coalesce((SELECT string_agg(identity_id, ',' ORDER BY rn) FROM ranked k
          WHERE k.source_line=r.source_line AND rn<=3),'') END AS candidate_ids
      FROM cloud_raw r JOIN scored s ON s.source_line=r.source_line""", "cloud_raw", "scored", "ranked", feed="cloud_raw"),
    "reconcile_cloud": _statement(f"""SELECT CASE WHEN decision='auto_match' THEN 'normalized' ELSE 'quarantined' END AS stage,
        {CLOUD_REASON} AS reason_code, count(*) AS row_count FROM scored GROUP BY ALL""", "scored", feed="cloud_raw"),
    "correlation_decisions": _statement("""SELECT k.source_line, decision, (rn-1)::INT AS position, identity_id, score, rule
      FROM ranked k JOIN scored USING (source_line) WHERE rn<=3""", "ranked", "scored", feed="cloud_raw"),
    "directory_classify": _statement("""SELECT source_line, sam AS native_id, decision, account_type, owner_identity_id, ownership_status, last_activity,
        CASE WHEN reason_code IN ('CORRELATION_AMBIGUOUS','UNOWNED_SERVICE_ACCOUNT','ORPHANED_DIRECTORY_ACCOUNT') THEN 'quarantined'
          ELSE 'normalized' END AS stage, reason_code FROM dir""", "dir", feed="dir_raw"),
    "directory_accounts": _statement("""SELECT sam AS native_id, upn AS username, account_type, owner_identity_id, ownership_status, source_line
      FROM (SELECT *, row_number() OVER (PARTITION BY sam ORDER BY source_line DESC) rn FROM dir) WHERE rn=1""", "dir", feed="dir_raw"),
    "directory_grants": _statement("""SELECT DISTINCT sam AS account_native_id, g AS entitlement_native_id
      FROM (SELECT sam, unnest(string_split(member_of,';')) AS g FROM dir_raw) WHERE g<>''""", "dir_raw"),
    "text_owner_mention": _statement("SELECT text, mentioned AS identity_id FROM mention", "mention"),
    "crm_accounts": _statement("SELECT * FROM crm_record", "crm_record"),
    "crm_grants": _statement("""SELECT native_id AS account_native_id, 'profile:'||profile AS entitlement_native_id, 'profile' AS type,
        (profile IN ('System Administrator','Sales Admin'))::INT AS privileged FROM crm_raw
      UNION SELECT native_id, 'permset:'||p, 'permission_set', (p IN ('Revenue_Admin','Data_Export'))::INT
        FROM (SELECT native_id, unnest(string_split(permission_sets,'|')) AS p FROM crm_raw) WHERE p<>''""", "crm_raw"),
    "iam_unique_owner": _statement("SELECT * FROM iam", "iam"),
    "iam_role_edges": """SELECT DISTINCT child, parent FROM (
        SELECT 'role-'||p_partkey AS child, 'role-'||(p_partkey//4) AS parent FROM part WHERE p_partkey>0 AND p_partkey%5=0
        UNION ALL SELECT 'role-'||(p_partkey//4), 'role-'||(p_partkey//16) FROM part WHERE p_partkey>0 AND p_partkey%5=0) WHERE child<>parent""",
    "iam_role_privilege": "SELECT 'role-'||p_partkey AS role_name, (p_size=50)::INT AS privileged FROM part",
    "sheet_header_detect": _statement("""SELECT sheet, header_row FROM header UNION ALL
        SELECT 'sheet '||s_suppkey, (s_suppkey%13+1)::INT FROM supplier WHERE s_suppkey%13<10
          AND len(list_filter(range(4), lambda i: s_suppkey%5+1+(s_suppkey+i)%4<=7 AND NOT (s_suppkey%7=0 AND i>1)))>=3""", "header"),
    "sheet_primary": _statement("""SELECT sheet, header_row, max_date::VARCHAR AS max_date,
        (sheet=(SELECT arg_max(sheet, max_date) FROM sheet_date))::INT AS is_primary FROM sheet_date""", "sheet_date"),
    "sheet_name_match": _statement("""SELECT sheet, source_line::INT AS source_line, raw_name, role, identity_id, match_rule, stage, reason_code
      FROM sheet_record""", "sheet_record"),
    "fuzzy_name_match": _statement(f"""SELECT probe_name, index_name, round(ratio,6) AS ratio FROM (
        SELECT probe_name, index_name, {_ratio('probe_name', 'index_name')} AS ratio FROM near_name) WHERE ratio>=90""", "near_name"),
    "fuzzy_long_names": _statement(f"""SELECT probe_name, index_name, round(ratio,6) AS ratio FROM (
        SELECT probe_name, index_name, {_ratio('probe_name', 'index_name')} AS ratio FROM near_long) WHERE ratio>=90""", "near_long"),
    "source_upsert": """WITH o AS (SELECT *, o_orderkey||'|'||o_orderpriority||'|same' AS old_p,
          o_orderkey||'|'||o_orderpriority||'|'||CASE WHEN o_orderkey%15=4 THEN 'changed' ELSE 'same' END AS new_p,
          CASE WHEN o_orderkey%4=0 THEN 'sheet' END AS source_sheet FROM orders),
        was AS (SELECT source_sheet, o_orderkey+2 AS source_line, sha256(old_p) AS raw_hash, 'run-1' AS run_id FROM o
          WHERE o_orderdate<TIMESTAMP '2001-01-01'),
        now_ AS (SELECT source_sheet, o_orderkey+2 AS source_line, sha256(new_p) AS raw_hash, 'run-2' AS run_id FROM o
          WHERE o_orderdate>=TIMESTAMP '1995-07-01')
      SELECT * FROM was UNION ALL SELECT * FROM now_ n WHERE NOT EXISTS (SELECT 1 FROM was w WHERE w.source_line=n.source_line
        AND w.raw_hash=n.raw_hash AND w.source_sheet IS NOT DISTINCT FROM n.source_sheet)""",
    "quarantine_merge": """SELECT CASE WHEN o_orderkey%4=0 THEN 'sheet' END AS source_sheet, o_orderkey+2 AS source_line, 'NO_IDENTITY_MATCH' AS reason_code,
        CASE WHEN fresh THEN 'run-2 saw ' ELSE 'run-1 saw ' END||o_orderkey AS explanation, o_custkey::VARCHAR AS candidate_ids,
        CASE WHEN known AND o_orderkey%6=0 OR fresh AND o_orderkey%5=0 THEN 'resolved' ELSE 'open' END AS status,
        CASE WHEN known AND o_orderkey%6=0 THEN 'confirmed by hand' WHEN fresh AND o_orderkey%5=0 THEN 'auto-resolved' END AS resolution,
        CASE WHEN known AND o_orderkey%6=0 THEN 'person' WHEN fresh AND o_orderkey%5=0 THEN 'system' END AS resolved_by,
        CASE WHEN known AND o_orderkey%6=0 OR fresh AND o_orderkey%5=0 THEN '2001-12-31' END AS resolved_at
      FROM (SELECT *, o_orderdate<TIMESTAMP '2001-01-01' AS known, o_orderdate>=TIMESTAMP '1995-07-01' AS fresh FROM orders) WHERE known OR fresh""",
    "record_outcomes": """SELECT CASE WHEN o_orderkey%4=0 THEN 'sheet' END AS source_sheet, o_orderkey+2 AS source_line, CASE WHEN o_orderdate<TIMESTAMP '2001-01-01' THEN 'quarantined' ELSE 'normalized' END
        AS outcome FROM orders""",
    "account_snapshot": _statement("""SELECT native_id, origin, source_line FROM (SELECT *, row_number() OVER (PARTITION BY native_id
        ORDER BY side DESC, source_line DESC) rn FROM (SELECT local AS native_id, profile AS origin, source_line, 0 AS side FROM crm_raw
        UNION ALL SELECT lower(sam), description, source_line, 1 FROM dir_raw)) WHERE rn=1""", "crm_raw", "dir_raw"),
    "entitlement_closure": _statement("SELECT root_id, node_id, depth, array_to_string(path,' -> ') AS path FROM closure", "closure"),
    "effective_access": _statement("""SELECT identity_id, account_id, application, granted_id, entitlement_id, entitlement_type, privileged,
        grant_type, depth, path FROM access""", "access"),
    "why_entitlement": _statement("""SELECT identity_id, account_id, application, granted_id, entitlement_id, entitlement_name,
        CASE WHEN grant_type='direct' THEN 'direct grant' ELSE path END AS how FROM access WHERE contains(lower(entitlement_name),'promo')""", "access"),
    "identity_360": _statement("""SELECT i.identity_id, i.name, i.title, i.department, i.lifecycle_status, a.account_id, a.application,
        a.entitlement_name, a.entitlement_type, a.path AS how FROM access a JOIN identity i USING (identity_id)
      WHERE contains(lower(i.name),'alber')""", "access", "identity"),
    "reviewer_routing": _statement("SELECT identity_id, reviewer_id::VARCHAR AS reviewer_id, reviewer_route FROM route", "route"),
    "birthright": _statement("SELECT identity_id, entitlement_id, round(prevalence,6) AS prevalence FROM right_", "right_"),
    "joiner_plan": _statement("""SELECT r.identity_id, r.entitlement_id, e.application,
        CASE WHEN h.account_id IS NULL AND f THEN 'pending' ELSE 'auto_approved' END AS decision,
        CASE WHEN h.account_id IS NOT NULL THEN 'existing' WHEN f THEN 'failed' ELSE 'provision' END AS account_step,
        CASE WHEN h.account_id IS NULL AND f THEN 'deferred' WHEN l.account_id IS NOT NULL THEN 'already_held' ELSE 'grant' END AS grant_step,
        h.account_id::VARCHAR AS account_id,
        round_even(prevalence*100,0)::INT||'% of active people who are '||title||' in '||department||' have it' AS rationale
      FROM (SELECT *, identity_id%11=0 AS flaky FROM right_) r JOIN entitlement e USING (entitlement_id) JOIN identity i USING (identity_id)
      LEFT JOIN (SELECT owner_id, application, min(account_id) AS account_id FROM account WHERE owner_id IS NOT NULL GROUP BY ALL) h
        ON h.owner_id=r.identity_id AND h.application=e.application
      LEFT JOIN links l ON l.account_id=h.account_id AND l.entitlement_id=r.entitlement_id,
      LATERAL (SELECT r.flaky AND e.application=(""" + APPS + """)[r.identity_id%5+1] AS f)""",
                              "right_", "entitlement", "identity", "account", "links"),
    "mover_delta": _statement("""SELECT coalesce(h.identity_id, r.identity_id) AS identity_id, coalesce(h.entitlement_id, r.entitlement_id) AS entitlement_id,
        CASE WHEN r.identity_id IS NULL THEN 'revoke' WHEN h.identity_id IS NOT NULL THEN 'keep' WHEN home.a IS NULL THEN 'grant_without_account'
          ELSE 'grant' END AS action, coalesce(h.account_id, home.a)::VARCHAR AS account_id
      FROM (SELECT DISTINCT owner_id AS identity_id, entitlement_id, account_id FROM links JOIN account USING (account_id) WHERE owner_id IS NOT NULL) h
      FULL JOIN right_ r ON r.identity_id=h.identity_id AND r.entitlement_id=h.entitlement_id
      LEFT JOIN (SELECT owner_id, min(account_id) AS a FROM account GROUP BY owner_id) home ON home.owner_id=coalesce(h.identity_id, r.identity_id)""",
                              "links", "right_", "account"),
    "leaver_plan": _statement("""SELECT 'leaver:'||i.identity_id||':hr-'||i.identity_id AS idempotency_key, i.identity_id, 'execute' AS mode,
        i.lifecycle_status, count(s.account_id) AS account_count, count_if(coalesce(s.ok,false))::BIGINT AS disabled, count_if(coalesce(NOT s.ok,false))::BIGINT AS failed,
        coalesce(sum(CASE WHEN s.ok OR NOT s.enabled THEN l.n END),0)::BIGINT AS entitlements_revoked,
        count_if(coalesce(NOT s.ok AND s.enabled,false))::BIGINT AS deferred_accounts, count_if(coalesce(s.account_type='service',false))::BIGINT AS service_accounts,
        CASE WHEN count_if(coalesce(NOT s.ok,false))>0 THEN 'partially_failed' ELSE 'completed' END AS status
      FROM identity i LEFT JOIN leaver_step s ON s.identity_id=i.identity_id
      LEFT JOIN (SELECT account_id, count(*) n FROM links GROUP BY 1) l ON l.account_id=s.account_id GROUP BY i.identity_id, i.lifecycle_status""",
                              "identity", "leaver_step", "links"),
    "leaver_replay": _statement("""SELECT idempotency_key, step_name, CASE WHEN ok THEN 1 ELSE 2 END AS attempt, 'succeeded' AS status FROM leaver_step
      UNION ALL SELECT 'leaver:'||i.identity_id||':hr-'||i.identity_id, s.step, CASE WHEN s.step='revoke_entitlements' AND EXISTS (
          SELECT 1 FROM leaver_step x WHERE x.identity_id=i.identity_id AND NOT x.ok AND x.enabled) THEN 2 ELSE 1 END, 'succeeded'
        FROM identity i, (SELECT unnest(['discover','revoke_entitlements','flag_service_dependencies']) AS step) s
        WHERE i.lifecycle_status='terminated'""", "leaver_step", "identity"),
    "leaver_remaining_grants": _statement("""SELECT account_id, entitlement_id FROM links WHERE account_id NOT IN (
        SELECT account_id FROM leaver_step WHERE ok OR NOT enabled)""", "links", "leaver_step"),
    "leaver_audit": _statement("""SELECT 'disable_account' AS action, 'account' AS object_type, account_id::VARCHAR AS object_id,
        'enabled='||enabled::VARCHAR AS before_state, idempotency_key AS correlation_id FROM leaver_step WHERE ok
      UNION ALL SELECT DISTINCT 'flag_ownership_transfer_needed', 'identity', identity_id::VARCHAR, NULL, idempotency_key FROM leaver_step
        WHERE account_type='service'""", "leaver_step"),
    "workflow_dedup": """SELECT idempotency_key, workflow_type, identity_id, event_id FROM (SELECT *, workflow_type||':'||identity_id||':'||day
          AS idempotency_key, row_number() OVER (PARTITION BY workflow_type, identity_id, day ORDER BY ts, event_id) rn FROM (
        SELECT CASE event_type WHEN 'signup' THEN 'joiner' WHEN 'error' THEN 'leaver' ELSE 'mover' END AS workflow_type, user_id AS identity_id,
          strftime(ts,'%Y-%m-%d') AS day, ts, event_id FROM events)) WHERE rn=1""",
    "campaign_items": _statement("""SELECT account_id, entitlement_id, identity_id, reviewer_id::VARCHAR AS reviewer_id, reviewer_route FROM item""", "item"),
    "campaign_launch_gate": _statement("""SELECT application, source_system, watermark_run_id, round(hours,4) AS hours_since, stale,
        CASE WHEN watermark_run_id IS NULL THEN 'NO_SUCCESSFUL_RUN' WHEN stale=1 THEN 'STALE_SOURCE' ELSE 'LAUNCH' END AS verdict
      FROM application JOIN health USING (source_system)""", "application", "health"),
    "campaign_rejected": _statement("SELECT account_id, entitlement_id, 'revoke' AS decision, 'reviewer' AS actor FROM decided WHERE s=2", "decided"),
    "campaign_progress": _statement("""SELECT count(*) AS total, count(decision) AS decided, count_if(decision IS NULL)::BIGINT AS pending,
        count_if(reviewer_id IS NULL)::BIGINT AS unassigned, count_if(decision='approve')::BIGINT AS approve_count,
        count_if(decision='revoke')::BIGINT AS revoke_count, count_if(decision='delegate')::BIGINT AS delegate_count FROM decided""", "decided"),
    "evidence_pack": _statement("""SELECT d.account_id, d.entitlement_id, i.name AS identity, e.name AS entitlement, reviewer_route,
        coalesce(m.name,'UNASSIGNED -- IAM fallback queue') AS reviewer, coalesce(decision,'PENDING') AS decision,
        CASE WHEN decision='revoke' THEN 'not needed' END AS reason, CASE WHEN decision IS NOT NULL THEN '2001-12-31 00:00:00' END AS decided_at,
        CASE WHEN decision='revoke' THEN 'executed' ELSE 'n/a' END AS revocation_executed
      FROM decided d JOIN identity i ON i.identity_id=d.identity_id JOIN entitlement e ON e.entitlement_id=d.entitlement_id
      LEFT JOIN identity m ON m.identity_id=d.reviewer_id""", "decided", "identity", "entitlement"),
    "execute_revocations": _statement("""SELECT account_id, entitlement_id FROM links ANTI JOIN (SELECT account_id, entitlement_id FROM decided
        WHERE decision='revoke') d USING (account_id, entitlement_id)""", "links", "decided"),
    "campaign_why_not": _statement("""SELECT i.identity_id, i.name, coalesce(c.n,0) AS review_items, CASE WHEN c.n>0 THEN 'IN_CAMPAIGN'
        WHEN o.identity_id IS NULL THEN 'NO_ACCOUNT' WHEN o.empty>0 THEN 'NO_ENTITLEMENTS' ELSE 'AFTER_WATERMARK' END AS reason_code
      FROM identity i LEFT JOIN (SELECT identity_id, count(*) n FROM item GROUP BY 1) c USING (identity_id)
      LEFT JOIN (SELECT owner_id AS identity_id, count_if(account_id NOT IN (SELECT account_id FROM links)) AS empty FROM account
        WHERE application='1-URGENT' AND owner_id IS NOT NULL GROUP BY 1) o USING (identity_id)""", "identity", "item", "account", "links"),
    "run_diff": _statement("""SELECT a.run_id AS run_a, b.run_id AS run_b, m.stage, m.reason_code, coalesce(sum(n) FILTER (m.run_id=a.run_id),0)::BIGINT AS count_a,
        coalesce(sum(n) FILTER (m.run_id=b.run_id),0)::BIGINT AS count_b,
        (coalesce(sum(n) FILTER (m.run_id=b.run_id),0)-coalesce(sum(n) FILTER (m.run_id=a.run_id),0))::BIGINT AS delta
      FROM run a JOIN run b ON b.source_system=a.source_system AND b.day=a.day+1
      JOIN (SELECT run_id, stage, reason_code, count(*) n FROM run_record GROUP BY ALL) m ON m.run_id IN (a.run_id, b.run_id) GROUP BY ALL""",
                           "run", "run_record"),
    "run_reconcile": _statement("""SELECT run_id, count(*) AS rows_in, count_if(stage='normalized')::BIGINT AS rows_normalized,
        count_if(stage='quarantined')::BIGINT AS rows_quarantined, 1 AS invariant_ok FROM run_record GROUP BY run_id""", "run_record"),
    "source_health": _statement("""SELECT source_system, last_run_status, strftime(completed_at,'%Y-%m-%d %H:%M:%S') AS last_completed_at,
        round(hours,4) AS hours_since, stale FROM health""", "health"),
    "overall_health": _statement("""SELECT CASE WHEN sum(stale)=0 THEN 'healthy' ELSE 'degraded' END AS status, sum(stale)::BIGINT AS stale_sources
      FROM health""", "health"),
    "exec_value": _statement("""SELECT (SELECT count(*) FROM account JOIN identity ON owner_id=identity_id WHERE lifecycle_status='terminated'
          AND NOT enabled) AS terminated_closed,
        (SELECT count(*) FROM account JOIN identity ON owner_id=identity_id WHERE lifecycle_status='terminated' AND enabled) AS terminated_open,
        (SELECT count(*) FROM decided WHERE decision='revoke') AS revoked, (SELECT count(*) FROM finding WHERE status='open') AS open_findings""",
                             "account", "identity", "decided", "finding"),
    "correlation_eval": _statement("""SELECT label, tp, fp, fn, round(tp/nullif(tp+fp,0),6) AS precision, round(tp/nullif(tp+fn,0),6) AS recall FROM (
        SELECT label, count_if(truth=label AND hit)::BIGINT AS tp, count_if(truth<>label AND hit)::BIGINT AS fp,
          count_if(truth=label AND NOT hit)::BIGINT AS fn FROM (
          SELECT unnest(['contractor','service','orphan']) AS label,
            unnest([ownership_status='contractor', account_type='service', ownership_status='orphan']) AS hit,
            CASE WHEN (source_line-2)%19=0 THEN 'contractor' WHEN (source_line-2)%17 IN (1,2) THEN 'service'
              WHEN (source_line-2)%17=0 THEN 'orphan' ELSE '' END AS truth FROM dir) GROUP BY label)""", "dir", feed="dir_raw"),
    "iam_eval": _statement("""SELECT 'no_human_match' AS label, tp, fp, fn, round(tp/nullif(tp+fp,0),6) AS precision, round(tp/nullif(tp+fn,0),6) AS recall
      FROM (SELECT count_if(e AND p)::BIGINT AS tp, count_if(NOT e AND p)::BIGINT AS fp, count_if(e AND NOT p)::BIGINT AS fn FROM (
        SELECT username LIKE 'automation-%' AS e, owner_identity_id IS NULL AS p FROM iam))""", "iam"),
    "reconcile_all": _statement(f"""SELECT source, stage, reason_code, count(*) AS row_count FROM (
        SELECT 'cloud_directory' AS source, CASE WHEN decision='auto_match' THEN 'normalized' ELSE 'quarantined' END AS stage,
          {CLOUD_REASON} AS reason_code FROM scored_cloud
        UNION ALL SELECT 'directory', stage, reason_code FROM dir_stage UNION ALL SELECT 'crm', stage, reason_code FROM crm_record
        UNION ALL SELECT 'cloud_iam', stage, reason_code FROM iam UNION ALL SELECT 'spreadsheet', stage, reason_code FROM sheet_record)
      GROUP BY ALL""", "scored_cloud", "dir_stage", "crm_record", "iam", "sheet_record", feed="dir_raw"),
    "multi_account_people": _statement("""SELECT owner_identity_id, count(*) AS accounts FROM (
        SELECT best_id AS owner_identity_id FROM scored_cloud WHERE decision='auto_match'
        UNION ALL SELECT owner_identity_id FROM (SELECT *, row_number() OVER (PARTITION BY sam ORDER BY source_line DESC) rn FROM dir)
          WHERE rn=1 AND owner_identity_id IS NOT NULL) GROUP BY owner_identity_id HAVING count(*)>=2""", "scored_cloud", "dir", feed="dir_raw"),
    "quarantine_open": _statement("""SELECT reason_code, source_line, candidate_ids FROM (SELECT source_line, norm_id AS candidate_ids,
          CASE WHEN reason_code='MALFORMED_CSV_ROW' THEN reason_code ELSE 'EMPLOYEE_ID_COLLISION' END AS reason_code
        FROM record WHERE quarantine_status='open') ORDER BY reason_code, source_line LIMIT 200""", "record"),
    "quarantine_counts": _statement("""SELECT CASE WHEN reason_code='MALFORMED_CSV_ROW' THEN reason_code ELSE 'EMPLOYEE_ID_COLLISION' END AS reason_code,
        quarantine_status AS status, count(*) AS row_count FROM record WHERE stage='quarantined' GROUP BY ALL""", "record"),
    "workflow_recent": """SELECT idempotency_key, workflow_type, event_id FROM (SELECT *, workflow_type||':'||identity_id||':'||day
          AS idempotency_key, row_number() OVER (PARTITION BY workflow_type, identity_id, day ORDER BY ts, event_id) rn FROM (
        SELECT CASE event_type WHEN 'signup' THEN 'joiner' WHEN 'error' THEN 'leaver' ELSE 'mover' END AS workflow_type, user_id AS identity_id,
          strftime(ts,'%Y-%m-%d') AS day, ts, event_id FROM events)) WHERE rn=1 ORDER BY ts DESC, idempotency_key LIMIT 100""",
}

_CHANGE = "(SELECT c_custkey AS k, CASE WHEN c_custkey%3=0 THEN 'execute' ELSE 'dry_run' END AS mode FROM customer WHERE c_custkey%3<2)"


def _runs(workflow: str, requests: str, counts: str, open_: str) -> str:
    return f"""SELECT *, CASE WHEN open>0 THEN 'partially_failed' ELSE 'completed' END AS status FROM (
        SELECT '{workflow}:'||k||':hr-'||k AS idempotency_key, k AS identity_id, mode, count_if(coalesce({counts}, false))::BIGINT AS requested,
          count_if(coalesce(mode='execute' AND {open_}, false))::BIGINT AS open FROM {_CHANGE} LEFT JOIN ({requests}) ON identity_id=k GROUP BY k, mode)"""


_FOUND = _statement("SELECT finding_key, rule_code, risk_score, status FROM finding", "finding")


def _findings_after(gone: str) -> str:
    return f"""WITH cur AS ({_FOUND}) SELECT * FROM cur
      UNION ALL SELECT finding_key, rule_code, 1, 'resolved' FROM cur WHERE ascii(right(finding_key, 1))%4=1
      UNION ALL SELECT 'GONE:identity:'||c_custkey, 'GONE', 2, {gone} FROM customer"""


_GROUPS = f"SELECT DISTINCT entitlement_native_id AS g FROM ({ORACLES['directory_grants']}) UNION SELECT unnest(['Plant-Ops-Leads','Manufacturing-All','All-Employees'])"

ORACLES |= {
    "findings_upsert": _findings_after("CASE WHEN c_custkey%2=0 THEN 'open' ELSE 'accepted' END"),
    "findings_upsert_resolved": _findings_after("'resolved'"),
    "ingest_entitlements": f"SELECT 'Directory' AS application, g AS native_id, g AS name, 'group' AS type, 0 AS privileged FROM ({_GROUPS})",
    "ingest_twice": f"""SELECT part, n AS first_load, n AS second_load FROM (
        SELECT 'accounts' AS part, count(*) AS n FROM ({ORACLES['directory_accounts']})
        UNION ALL SELECT 'entitlements', count(*) FROM ({_GROUPS}) UNION ALL SELECT 'grants', count(*) FROM ({ORACLES['directory_grants']})
        UNION ALL SELECT 'edges', 2 UNION ALL SELECT 'applications', 1
        UNION ALL SELECT unnest(['identities', 'aliases']), count(DISTINCT lower(native_id)) FROM ({ORACLES['directory_classify']})
          WHERE reason_code='CONTRACTOR_CLASSIFIED'
        UNION ALL SELECT 'quarantine', count(*) FROM ({ORACLES['directory_classify']}) WHERE stage='quarantined')""",
    "ingest_next": """SELECT 'crm'||o_orderkey AS native_id, ((o_orderkey%9<>0) = (o_orderkey%3=1))::INT AS enabled, o_orderkey+2 AS source_line
      FROM orders""",
    "joiner_runs": _runs("joiner", ORACLES["joiner_plan"], "decision IS NOT NULL", "decision='pending'"),
    "joiner_audit": f"""SELECT 'grant_entitlement' AS action, coalesce(account_id, 'new account')||'/'||entitlement_id AS object_id, rationale AS reason,
        'joiner:'||identity_id||':hr-'||identity_id AS correlation_id FROM ({ORACLES['joiner_plan']}) WHERE identity_id%3=0 AND grant_step='grant'""",
    "joiner_replay": f"""SELECT 'joiner:'||identity_id||':hr-'||identity_id AS idempotency_key, entitlement_id, decision, 'birthright' AS policy
      FROM (SELECT *, count_if(decision='pending') OVER (PARTITION BY identity_id) AS waiting FROM ({ORACLES['joiner_plan']}))
      WHERE identity_id%3=1 OR identity_id%3=0 AND waiting>0""",
    "mover_runs": _runs("mover", ORACLES["mover_delta"], "action<>'keep'", "action='grant_without_account'"),
    "mover_audit": f"""SELECT action||'_entitlement' AS action, account_id||'/'||entitlement_id AS object_id,
        'mover:'||identity_id||':hr-'||identity_id AS correlation_id FROM ({ORACLES['mover_delta']}) WHERE identity_id%3=0 AND action IN ('grant','revoke')""",
    "mover_grants": f"""WITH change AS (SELECT account_id::BIGINT AS account_id, entitlement_id, action FROM ({ORACLES['mover_delta']}) WHERE identity_id%3=0),
        held AS ({_statement('SELECT * FROM links', 'links')})
      SELECT account_id, entitlement_id FROM held ANTI JOIN (SELECT * FROM change WHERE action='revoke') c USING (account_id, entitlement_id)
      UNION SELECT account_id, entitlement_id FROM change WHERE action='grant'""",
    "leaver_both_modes": ORACLES["leaver_plan"],
    "campaign_redecided": _statement("""SELECT account_id, entitlement_id, CASE WHEN again THEN 'revoke' ELSE decision END AS decision,
        CASE WHEN again THEN 'second look' WHEN decision='revoke' THEN 'not needed' END AS reason,
        CASE WHEN again THEN 'second reviewer' WHEN decision IS NOT NULL THEN 'reviewer' END AS actor
      FROM (SELECT *, coalesce(decision='approve', false) AND account_id%2=0 AS again FROM decided)""", "decided"),
    "decision_audit": _statement("""SELECT 'reviewer' AS actor, 'review_decision:'||decision AS action, account_id||'/'||entitlement_id AS object_id,
        CASE WHEN decision='revoke' THEN 'not needed' END AS reason, '2001-12-31' AS decided_on FROM decided WHERE decision IS NOT NULL
      UNION ALL SELECT 'second reviewer', 'review_decision:revoke', account_id||'/'||entitlement_id, 'second look', '2002-01-01' FROM decided
        WHERE decision='approve' AND account_id%2=0""", "decided"),
}

_CHANGED = {
    "edge": (f"""SELECT child_id, parent_id FROM ({CTES['edge'][0]}) e WHERE NOT EXISTS (SELECT 1 FROM part p
          WHERE p_partkey%35=0 AND e.child_id='part:'||p_partkey AND e.parent_id='type:'||p_type)
        UNION SELECT 'part:'||p_partkey, 'type:'||p_type FROM part WHERE p_partkey%31=3""", ()),
    "links": (f"""SELECT account_id, entitlement_id FROM ({CTES['links'][0]}) WHERE NOT (account_id%97=5 AND starts_with(entitlement_id, 'part:'))
        UNION SELECT o_orderkey, 'type:'||({TYPES})[o_orderkey%6+1] FROM orders WHERE o_orderkey%89=1""", CTES["links"][1]),
}

ORACLES |= {
    "account_snapshot_bucketed": ORACLES["account_snapshot"],
    "application_keys": """SELECT p_brand AS application, (substr(p_brand,7,1)<'4')::INT AS known, 1 AS same_id, 1 AS gapless
      FROM part GROUP BY p_brand""",
    "access_after_change": _statement("SELECT identity_id, account_id, granted_id, entitlement_id, grant_type, depth, path FROM access", "access", instead=_CHANGED),
    "evidence_head": f"""SELECT *, count(*) OVER () AS total FROM ({ORACLES['evidence_pack']})
      ORDER BY identity NULLS FIRST, entitlement NULLS FIRST, account_id, entitlement_id LIMIT 30""",
    "metric_listing": _statement("""SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY stage, row_count DESC, reason_code)::INT AS position
      FROM (SELECT run_id, stage, reason_code, count(*) AS row_count FROM run_record GROUP BY ALL)""", "run_record"),
    "run_metrics": f"""SELECT 'directory-1' AS run_id, stage, reason_code, count(*) AS row_count, sum(count(*)) OVER ()::BIGINT AS rows_in,
        sum(count(*)) FILTER (stage='normalized') OVER ()::BIGINT AS rows_normalized,
        sum(count(*)) FILTER (stage='quarantined') OVER ()::BIGINT AS rows_quarantined, 'succeeded' AS status
      FROM ({ORACLES['directory_classify']}) GROUP BY stage, reason_code""",
}

ORACLES["label_eval"] = f"""WITH predicted AS (
        SELECT 'employee_id_collision' AS label_set, source_line::VARCHAR AS entity FROM ({ORACLES['standardise_roster']}) WHERE reason_code LIKE 'EMPLOYEE_ID_COLLISION%'
        UNION SELECT 'null_employee_id', source_line::VARCHAR FROM ({ORACLES['correlate_accounts']})
          WHERE decision='auto_match' AND ((source_line-2)%7=3 OR (source_line-2)%61=60)
        UNION SELECT 'stale_sheet', sheet||':'||source_line FROM ({ORACLES['sheet_name_match']}) WHERE reason_code='STALE_WORKSHEET_EXCLUDED'
        UNION SELECT 'legacy_domain', source_line::VARCHAR FROM ({ORACLES['crm_accounts']}) WHERE reason_code='CORRELATION_LEGACY_DOMAIN'
        UNION SELECT 'contractor', source_line::VARCHAR FROM ({ORACLES['directory_classify']}) WHERE ownership_status='contractor'
        UNION SELECT 'service_owner', source_line::VARCHAR FROM ({ORACLES['directory_classify']})
          WHERE account_type='service' AND ownership_status IN ('service_owned','service_owned_by_terminated')
        UNION SELECT 'dual_account', owner_identity_id FROM ({ORACLES['multi_account_people']})),
      expected AS (
        SELECT 'employee_id_collision' AS label_set, (c_custkey+2)::VARCHAR AS entity FROM customer WHERE c_custkey%97 IN (95, 96)
        UNION SELECT 'null_employee_id', (c_custkey+2)::VARCHAR FROM customer WHERE c_custkey%7=3 OR c_custkey%61=60
        UNION SELECT 'stale_sheet', 'Old extract:'||(c_custkey+2) FROM customer
        UNION SELECT 'legacy_domain', (o_orderkey+2)::VARCHAR FROM orders WHERE o_orderkey%16=0
        UNION SELECT 'contractor', (o_orderkey+2)::VARCHAR FROM orders WHERE o_orderkey%19=0
        UNION SELECT 'service_owner', (o_orderkey+2)::VARCHAR FROM orders WHERE o_orderkey%19<>0 AND o_orderkey%17=2
        UNION SELECT 'dual_account', {_eid('o_custkey+1')} FROM orders WHERE o_orderkey%19<>0 AND o_orderkey%17 NOT IN (0,1,2)),
      met AS (SELECT coalesce(p.label_set, e.label_set) AS label_set, p.entity IS NOT NULL AS p, e.entity IS NOT NULL AS e
        FROM predicted p FULL JOIN expected e ON p.label_set=e.label_set AND p.entity=e.entity)
      SELECT coalesce(label_set, 'all') AS label_set, tp, fp, fn, round(tp/nullif(tp+fp,0),6) AS precision, round(tp/nullif(tp+fn,0),6) AS recall
      FROM (SELECT label_set, count_if(p AND e)::BIGINT AS tp, count_if(p AND NOT e)::BIGINT AS fp, count_if(e AND NOT p)::BIGINT AS fn
        FROM met GROUP BY ROLLUP (label_set))"""
