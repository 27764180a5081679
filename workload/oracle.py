"""SQL answers to the registered queries, for DuckDB on the same tables."""

from __future__ import annotations

from workload.views import cte

ORACLE: dict[str, str] = {}

STAMP = "'%Y-%m-%d %H:%M:%S'"
# Python's white space as a list of characters for trim().
SPACES = " || ".join(
    f"chr({n})" for n in [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
)
REPO_OF = "concat('repo', cast(l_orderkey % 10 as varchar))"
SYMBOL_ORDER = "current_path, start_line, name, kind, end_line, commit_sha"

# ---- sources ----

ORACLE["pr_props_json"] = r"select event_id, cast(regexp_extract(props, '\"k\": (-?\d+)', 1) as bigint) as k from events"

ORACLE["vector_profile"] = """
    select cast(len(embedding) as int) as dim, count(*) as vectors, count(*) - count(vec_id) as null_ids
    from embeddings group by 1"""

ORACLE["paged_union"] = """
    with e as (select concat('repo', cast(user_id % 10 as varchar)) as source, event_id // 100 as page, event_id from events),
    c as (select source, page, count(*) as n from e group by all),
    r as (select source, page,
                 row_number() over (partition by source order by page) - 1 as expected,
                 min(n) over (partition by source order by page rows between unbounded preceding and 1 preceding) as fullest
          from c),
    ok as (select source, page from r where page = expected and coalesce(fullest, 4) >= 4)
    select source, page, event_id from e join ok using (source, page)"""

def _walked(numbers: str) -> str:
    """`w`: the numbers whose page counts, with repo, page and place."""
    return f"""
    a as (select i, i // 100 as b, i % 100 as place from ({numbers}) where not ((i // 100) % 7 = 6 and i % 100 = 99)),
    b as (select b, case when b % 18 = 13 then 0 else count(*) end as n from a group by b),
    r as (select b, n, min(n) over (partition by b // 10 order by b rows between unbounded preceding and 1 preceding) as least from b),
    w as (select i, 'repo' || (b // 10) as repo, b % 10 + 1 as page, cast(row_number() over (partition by b order by i) - 1 as int) as place
          from a join r using (b) where n > 0 and coalesce(least, 100) >= 100)"""


ORACLE["collected_commits"] = "with " + _walked("select o_orderkey as i from orders") + f"""
    , d as (
        select l_orderkey, string_agg('--- part_' || l_partkey || '.py' || chr(10) || '+' || cast(trunc(l_quantity) as int), chr(10)
                   order by l_linenumber, 'part_' || l_partkey || '.py', '+' || cast(trunc(l_quantity) as int)) as code_diff
        from lineitem where l_returnflag <> 'N' and l_linestatus = 'F' and l_orderkey % 17 <> 0 and l_orderkey % 13 <> 0 group by 1),
    k as (select * from w where i % 97 <> 5 qualify row_number() over (partition by repo order by i) <= 450)
    select repo, page, place, md5(cast(i as varchar)) as sha, o_orderpriority as message, 'customer' || o_custkey as author_name,
           strftime(o_orderdate, {STAMP}) as committed_at, 'https://host.example/commit/' || md5(cast(i as varchar)) as url,
           case when i % 11 = 3 then '' else coalesce(code_diff, '') end as code_diff
    from k join orders on o_orderkey = i left join d on l_orderkey = i
    union all
    select repo, page, -1, md5(cast(i as varchar)), null, null, null, null, null from w where i % 97 = 5"""

ORACLE["collected_prs"] = cte("v_prs") + ", " + _walked("select number as i from v_prs") + f"""
    select w.repo, page, place, number, title, case when state = 'open' then coalesce(props, '') else '' end as body, state, user_login,
           state as head_ref, case when state = 'closed' then strftime(created_at, {STAMP}) end as closed_at,
           case when number % 5 in (2, 3) and not starts_with(title, 'error') then coalesce(props, '') else '' end as code_diff
    from w join v_prs on number = i where number % 53 <> 0"""

# ---- projections ----

ORACLE["url_parts"] = """
    with p as (select page_id, url, split_part(url, '/', 3) as host, starts_with(url, 'https://') as known,
                      string_split(rtrim(substr(url, length(split_part(url, '/', 3)) + 10), '/'), '/') as parts
               from pages)
    select page_id, host,
           case when known and len(parts) >= 2 then parts[1] end as owner,
           case when known and len(parts) >= 2 then parts[2] end as repo,
           case when known and len(parts) >= 2 then parts[1] || '/' || parts[2] end as full_name,
           case when not known then 'unsupported url' when len(parts) < 2 then 'owner and repository expected' end as error,
           case when not known then 'unsupported url' when len(parts) <> 2 then 'owner and repository expected' end as strict_error
    from p"""

ORACLE["commit_flatten"] = cte("v_commits") + f"""
    select repo, commit_sha as sha, message, author_name, author_email, author_name as committer_name,
           'https://host.example/' || repo || '/commit/' || commit_sha as url,
           strftime(committed_at, {STAMP}) as authored_at, strftime(committed_at, {STAMP}) as committed_at
    from v_commits"""

ORACLE["pr_flatten"] = cte("v_prs") + f"""
    select repo, number, title, case when state = 'open' then coalesce(props, '') else '' end as body, state, user_login,
           state as head_ref, md5(title) as base_sha, strftime(created_at, {STAMP}) as created_at,
           case when state = 'closed' then strftime(created_at, {STAMP}) end as closed_at, cast(null as varchar) as merged_at
    from v_prs"""

ORACLE["commit_json_source"] = f"select * exclude (repo) from ({ORACLE['commit_flatten']})"

ORACLE["commit_array_split"] = ORACLE["commit_json_source"]
ORACLE["pr_json_source"] = cte("v_prs") + f"""
    select number, title, case when state = 'open' then coalesce(props, '') else '' end as body, state, user_login,
           state as head_ref, md5(title) as base_sha, strftime(created_at, {STAMP}) as created_at, strftime(created_at, {STAMP}) as updated_at,
           case when state = 'closed' then strftime(created_at, {STAMP}) end as closed_at, cast(null as varchar) as merged_at
    from v_prs"""

ORACLE["tolerant_load"] = cte("v_commits") + """
    select 'document' as kind, commit_sha as name from v_commits
    union all select 'quarantine', cast(item_id as varchar) from benchmark"""

ORACLE["lineage_round_trip"] = cte("v_commits", "v_files") + """
    select repo, 'commit' as kind, commit_sha as name from v_commits
    union all select repo, 'file', current_path from v_files"""

K = r"cast(regexp_extract(props, '\"k\": (-?\d+)', 1) as bigint)"

ORACLE["repo_meta_defaults"] = f"""
    select event_id,
           case event_id % 3 when 0 then 'user' || user_id else '' end as name,
           case event_id % 3 when 0 then null else '' end as description,
           case event_id % 3 when 1 then event_type else '' end as language,
           case event_id % 3 when 0 then cast({K} as varchar) else '0' end as stars,
           case event_id % 3 when 1 then null else '0' end as forks
    from events"""

ORACLE["malformed_skip"] = """
    select event_id, md5(props) as sha, case event_id % 5 when 0 then event_type end as message,
           'user' || user_id as author, 'u@example.com' as email, '2024-01-01' as date
    from events where event_id % 5 in (0, 1)"""

ORACLE["language_counts"] = cte("v_files") + r"""
    select case regexp_extract(current_path, '\.[a-z]+$') when '.py' then 'python' when '.ts' then 'typescript' when '.tsx' then 'typescript'
           when '.js' then 'javascript' when '.jsx' then 'javascript' else 'none' end as language, count(*) as files
    from v_files group by 1"""

ORACLE["commit_diff"] = """
    with d as (
        select l_orderkey, string_agg('--- part_' || l_partkey || '.py' || chr(10) || '+' || cast(trunc(l_quantity) as int), chr(10)
                   order by l_linenumber, 'part_' || l_partkey || '.py', '+' || cast(trunc(l_quantity) as int)) as code_diff
        from lineitem where l_returnflag <> 'N' and l_linestatus = 'F' group by 1)
    select o_orderkey, coalesce(code_diff, '') as code_diff from orders left join d on o_orderkey = l_orderkey"""

ORACLE["pr_patch_fallback"] = """
    select event_id, case when event_type not in ('view', 'signup', 'error') and value >= 10 then coalesce(props, '') else '' end as code_diff
    from events"""

ORACLE["commit_normalize"] = f"""
    select conv_id, turn, trim(text, {SPACES}) as message,
           strftime(timestamp '1970-01-01' + to_seconds(conv_id * 3600 + turn), {STAMP}) as committed_at
    from conversations"""

ORACLE["message_preview"] = """
    select conv_id, turn, substr(text, 1, 80) as preview, substr(md5(text), 1, 8) as short_sha from conversations"""

# ---- filters ----

ORACLE["ext_filter"] = cte("v_files") + """
    , s as (select repo, current_path, string_split(current_path, '.')[-1] as suffix from v_files)
    select repo, current_path,
           suffix in ('py', 'js', 'ts', 'java', 'go', 'cpp', 'c', 'jsx', 'tsx') as service,
           suffix in ('py', 'js', 'ts', 'java', 'go', 'cpp', 'c') as head,
           suffix in ('py', 'js', 'ts', 'jsx', 'tsx') as entity
    from s"""

ORACLE["dir_exclusion"] = cte("v_files") + r"""
    , s as (select repo, case when file_id % 11 = 0 then '.github/' || current_path else current_path end as current_path from v_files),
    d as (select *, string_split(current_path, '/')[:-2] as dirs, regexp_extract(current_path, '^(.*)/', 1) as dir from s)
    select repo, current_path,
           len(list_filter(dirs, lambda x: starts_with(x, '.') or x in ('node_modules', '__pycache__', 'venv'))) > 0 as by_segment,
           regexp_matches(dir, '\.git|node_modules|__pycache__|venv|dist|build') as by_word,
           starts_with(current_path, '.git') as by_prefix
    from d"""

ORACLE["blank_filter"] = f"""
    select conv_id, turn, text is null or trim(text, {SPACES}) = '' as text_blank,
           not (conv_id % 4 = 0 and text is not null and trim(text, {SPACES}) <> '') as body_blank
    from conversations"""

LISTED = "f.repo, f.current_path, s.kind, s.name, s.start_line, s.end_line"
JOINED = "v_symbols s join v_files f on s.repo = f.repo and s.file_id = f.file_id"

ORACLE["symbol_search"] = cte("v_files", "v_symbols") + f"""
    , p(pattern) as (values ('load_1'), ('D_2_'), ('OAD%9'))
    select {LISTED}, p.pattern from {JOINED} join p on lower(s.name) like '%' || lower(p.pattern) || '%'"""

ORACLE["symbol_search_indexed"] = ORACLE["symbol_search"]
ORACLE["top_function_files"] = cte("v_files", "v_symbols") + f"""
    select f.repo, f.current_path, count(*) as func_count from {JOINED} where s.kind = 'function'
    group by all order by func_count desc, f.repo, f.current_path limit 10"""

# ---- upserts and constraints ----

ORACLE["upsert_commits"] = f"""
    select user_id, event_id, strftime(ts, {STAMP}) as ts, event_type, value from events
    qualify row_number() over (partition by user_id order by (event_type = 'signup') desc, ts, event_id) = 1"""

ORACLE["file_dictionary"] = cte("v_files") + """
    select repo, current_path, cast(1 as bigint) as ids, cast(1 as bigint) as entries from v_files group by repo, current_path"""

ORACLE["symbols_append"] = cte("v_symbols") + """
    , again as (select distinct repo, commit_sha from v_symbols where kind = 'class')
    select repo, file_id, commit_sha, kind, name, start_line, end_line from v_symbols s
    where not exists (select 1 from again a where a.repo = s.repo and a.commit_sha = s.commit_sha)
    union all
    select repo, file_id, commit_sha, kind, 'again_' || name, start_line, end_line from v_symbols where kind = 'class'"""

ORACLE["constraint_violations"] = """
    with s as (
        select l_orderkey, l_linenumber,
               case when l_returnflag = 'R' then 'class' when l_returnflag = 'A' then 'function' when l_linestatus = 'O' then 'method' end as kind,
               case when l_linenumber = 7 then 'file_id is null' when l_linenumber = 6 then 'commit_sha is null'
                    when not l_discount > 0 then 'name is null'
                    when l_returnflag = 'N' and l_linestatus = 'O' then 'kind not allowed' end as violation
        from lineitem)
    select violation, kind, l_linenumber, count(*) as n, cast(sum(l_orderkey) as bigint) as order_sum
    from s where violation is not null group by all"""

ORACLE["orphan_symbols"] = cte("v_files", "v_commits", "v_symbols") + """
    select 'repo' as repo, s.* exclude (repo), 'files' as missing from v_symbols s
    where not exists (select 1 from v_files f where f.file_id = s.file_id and f.current_path not like '%.go')
    union all
    select 'repo' as repo, s.* exclude (repo), 'commits' as missing from v_symbols s
    where not exists (select 1 from v_commits c where c.commit_sha = s.commit_sha and c.message not like '1-%')"""

ORACLE["head_fallback"] = cte("v_commits", "v_repos") + """
    , r as (select distinct concat('repo', cast(p_partkey % 13 as varchar)) as repo from part),
    n as (select repo, commit_sha from v_commits qualify row_number() over (partition by repo order by committed_at desc, commit_sha desc) = 1),
    h as (select repo, md5(description) as head_sha from v_repos where description <> '' and repo <> 'repo1')
    select r.repo, coalesce(h.head_sha, n.commit_sha, 'unknown') as commit_sha
    from r left join n on n.repo = r.repo left join h on h.repo = r.repo"""

# ---- lookups and statistics ----

ORACLE["all_symbols"] = cte("v_files", "v_symbols") + f" select {LISTED} from {JOINED}"

STATS = """
    , st as (
        select f.repo, f.current_path, count(*) filter (s.kind = 'function') as functions, count(*) filter (s.kind = 'class') as classes
        from v_files f left join v_symbols s on s.repo = f.repo and s.file_id = f.file_id group by all)"""

ORACLE["file_statistics"] = cte("v_files", "v_symbols") + STATS + " select * from st"

COMMITS50 = """
    , c50 as (select *, row_number() over (partition by repo order by committed_at desc, commit_sha) as rank from v_commits qualify rank <= 50)"""
PRS30 = """
    , p30 as (select *, row_number() over (partition by repo order by created_at desc, number desc) as rank from v_prs qualify rank <= 30)"""
SYMBOLS200 = f"""
    , s200 as (
        select f.current_path, s.*, row_number() over (partition by f.repo order by {SYMBOL_ORDER}) as rank from {JOINED} qualify rank <= 200)"""
FILES50 = """
    , f50 as (select *, row_number() over (partition by repo order by functions + classes desc, current_path) as rank from st qualify rank <= 50)"""

ORACLE["recent_commits"] = cte("v_commits") + COMMITS50 + f"""
    select repo, cast(rank as int) as rank, commit_sha, message, strftime(committed_at, {STAMP}) as committed_at from c50"""

ORACLE["recent_prs"] = cte("v_prs") + PRS30 + " select repo, cast(rank as int) as rank, number, title, state from p30"

ORACLE["updated_prs"] = cte("v_prs") + f"""
    , u as (select *, case when number % 3 = 0 then created_at + to_days(cast(number % 400 as int)) else created_at end as updated_at from v_prs),
    r as (select *, row_number() over (partition by repo order by updated_at desc nulls last, number desc) as rank from u)
    select repo, cast(rank as int) as rank, number, title, strftime(updated_at, {STAMP}) as updated_at from r where rank <= 30"""

ORACLE["report_caps"] = cte("v_files", "v_symbols") + STATS + SYMBOLS200 + FILES50 + """
    select repo, 'symbols' as section, cast(rank as int) as rank, current_path || ':' || start_line || ':' || name as item from s200
    union all
    select repo, 'files', cast(rank as int), current_path || ':' || functions || ':' || classes from f50"""

ORACLE["entity_type_counts"] = """
    select 'class' as type, 2 * count(distinct l_orderkey) as entities from lineitem
    union all select 'function', 2 * count(*) from lineitem"""

ORACLE["repo_stats"] = cte("v_repos", "v_commits", "v_prs", "v_files", "v_symbols") + """
    select r.repo,
           (select count(*) from v_commits c where c.repo = r.repo) as commits_count,
           (select count(*) from v_prs p where p.repo = r.repo) as prs_count,
           (select count(*) from v_symbols s where s.repo = r.repo and kind = 'function') as functions_count,
           (select count(*) from v_symbols s where s.repo = r.repo and kind = 'class') as classes_count,
           (select count(distinct s.file_id) from v_symbols s join v_files f on f.repo = s.repo and f.file_id = s.file_id where s.repo = r.repo) as files_count
    from v_repos r"""

NAMES = """
    , nf as (
        select repo, current_path, min(rank) as seen,
               array_to_string((list(name order by rank) filter (kind = 'function'))[:10], ', ') as functions,
               array_to_string((list(name order by rank) filter (kind = 'class'))[:10], ', ') as classes
        from s200 where rank <= 100 group by all),
    n10 as (select *, row_number() over (partition by repo order by seen) as file_rank from nf qualify file_rank <= 10)"""

ORACLE["names_by_file"] = cte("v_files", "v_symbols") + SYMBOLS200 + NAMES + """
    select repo, cast(file_rank as int) as file_rank, current_path, coalesce(functions, '') as functions, coalesce(classes, '') as classes from n10"""

# ---- code entities ----

NUMBERED = f"""
    with m as (
        select l_orderkey, l_suppkey, {REPO_OF} as repo, cast(l_orderkey as varchar) as k,
               cast(row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) as int) as rn
        from lineitem),
    o as (select l_orderkey, repo, k, cast(count(*) as int) as n from m group by all)"""

JS = NUMBERED + """,
    js as (
        select repo, 'src/order_' || k || '.js' as path, 'class' as type, 'Order_' || k as name, 1 as start_line, 3 * n + 2 as end_line,
               'class_declaration' as node_type from o
        union all
        select repo, 'src/order_' || k || '.js', 'function', 'f_' || rn, 3 * rn - 1, 3 * rn + 1, 'function_declaration' from m)"""

PY = """,
    py as (
        select repo, 'src/order_' || k || '.py' as path, 'class' as type, 'Order_' || k as name, 1 as start_line, 2 * n + 1 as end_line,
               'class_definition' as node_type from o
        union all
        select repo, 'src/order_' || k || '.py', 'function', 'm_' || rn, 2 * rn, 2 * rn + 1, 'function_definition' from m)"""

JS_METHOD = "'  const f_' || rn || ' = (x) => {' || chr(10) || '    return x * ' || l_suppkey || ';' || chr(10) || '  }'"
PY_METHOD = "'    def m_' || rn || '(self):' || chr(10) || '        return ' || l_suppkey"
JS_CODE = f""",
    js_code as (
        select 'src/order_' || k || '.js' as path, 'f_' || rn as name, {JS_METHOD} as code from m
        union all
        select 'src/order_' || k || '.js', 'Order_' || k,
               'class Order_' || k || ' {{' || chr(10) || string_agg({JS_METHOD}, chr(10) order by rn) || chr(10) || '}}' from m group by k)""".replace("{{", "{").replace("}}", "}")
PY_CODE = f""",
    py_code as (
        select 'src/order_' || k || '.py' as path, 'm_' || rn as name, {PY_METHOD} as code from m
        union all
        select 'src/order_' || k || '.py', 'Order_' || k,
               'class Order_' || k || ':' || chr(10) || string_agg({PY_METHOD}, chr(10) order by rn) from m group by k)"""

ORACLE["code_lines"] = f"""
    with l as (select lang as repo, cast(doc_id as varchar) as path, string_split(text, chr(10)) as parts from documents),
    x as (select repo, path, unnest(range(1, len(parts) + 1)) as line_at, unnest(parts) as line from l)
    select repo, path, cast(line_at as int) as line_no, line from x
    where trim(line, {SPACES}) <> '' and not starts_with(trim(line, {SPACES}), '//') and not starts_with(trim(line, {SPACES}), '/*')"""

ORACLE["js_functions"] = JS + """
    select repo, path, 'javascript' as language, name, start_line as line_no from js where type = 'function'"""
ORACLE["js_classes"] = JS + " select repo, path, type, name, start_line as line_no from js where type = 'class'"
ORACLE["js_block_end"] = JS + " select repo, path, type, name, start_line, end_line from js"
ORACLE["js_forms"] = f"""
    with m as (
        select l_orderkey, {REPO_OF} as repo, l_partkey % 14 as form, l_returnflag || l_linestatus as state,
               cast(row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_returnflag || l_linestatus) as int) as rn
        from lineitem),
    c as (
        select *, sum(case when form = 13 then 0 when state = 'RO' then 1 when state = 'AF' then -1 else 0 end) over (partition by l_orderkey order by rn) as depth,
               3 * count(*) over (partition by l_orderkey) as n_lines from m),
    lower as (
        select i.l_orderkey, i.rn, min(3 * j.rn) as closes from c i join c j on j.l_orderkey = i.l_orderkey and j.rn > i.rn and j.depth < i.depth
        where i.state = 'RO' and i.form <> 13 group by all),
    b as (
        select c.*, case when form = 13 then null when state = 'AF' then 3 * rn - 1 when state = 'RO' then coalesce(closes, n_lines) else 3 * rn end as block_end
        from c left join lower using (l_orderkey, rn)),
    e as (
        select *, coalesce(block_end, first_value(block_end ignore nulls) over (partition by l_orderkey order by rn rows between 1 following and unbounded following),
                           n_lines) as end_at from b),
    named as (
        select *, case when form in (0, 1, 2, 3, 4, 13) then 'f_' || rn when form = 12 then 'g_' || rn end as f_name,
               case form when 6 then 'C_' when 7 then 'I_' when 8 then 'T_' when 9 then 'E_' when 10 then 'type_' when 12 then 'C_' end || rn as c_name,
               case form when 7 then 'interface' when 8 then 'type' when 9 then 'enum' when 10 then 'type' else 'class' end as label,
               'src/order_' || l_orderkey || case l_orderkey % 3 when 0 then '.js' when 1 then '.ts' else '.jsx' end as path,
               case l_orderkey % 3 when 1 then 'typescript' else 'javascript' end as language from e)
    select repo, path, language, 'function' as type, f_name as name, 3 * rn - 2 as start_line, cast(end_at as int) as end_line, 'function_declaration' as node_type
    from named where f_name is not null
    union all
    select repo, path, language, label, c_name, 3 * rn - 2, cast(end_at as int), 'class_declaration' from named where c_name is not null"""
ORACLE["code_snippet"] = JS + JS_CODE + " select path, name, start_line, end_line, code from js join js_code using (path, name)"
ORACLE["py_entities"] = NUMBERED + PY + PY_CODE + """
    select repo, path, type, name, start_line, end_line, code from py join py_code using (path, name)"""
ORACLE["entity_sink"] = ORACLE["py_entities"]
ORACLE["py_docstrings"] = NUMBERED + """
    select 'src/order_' || k || '.py' as path, 'class' as type, 'Order_' || k as name, '' as docstring, 1 as start_line, 4 * n + 1 as end_line from o
    union all
    select 'src/order_' || k || '.py', 'function', 'm_' || rn, 'Supplier ' || l_suppkey || '.', 4 * rn - 1, 4 * rn + 1 from m"""
ORACLE["py_entities_decorated"] = NUMBERED + """
    select 'src/order_' || k || '.py' as path, 'class' as type, 'Order_' || k as name, 1 as start_line, 4 * n + 1 as end_line from o
    union all
    select 'src/order_' || k || '.py', 'function', 'm_' || rn, 4 * rn - 2, 4 * rn + 1 from m"""
ORACLE["entity_union"] = JS + PY + JS_CODE + PY_CODE + """
    select repo, type, name, 'javascript' as language, path, cast(null as varchar) as class_context, '' as docstring,
           md5(code) as code_md5, start_line, end_line, node_type from js join js_code using (path, name)
    union all
    select repo, type, name, 'python', path, null, '', md5(code), start_line, end_line, node_type from py join py_code using (path, name)"""
ORACLE["index_pipeline"] = cte("v_commits") + ", " + (NUMBERED + PY).strip()[len("with "):] + """
    , h as (select repo, commit_sha from v_commits qualify row_number() over (partition by repo order by committed_at desc, commit_sha desc) = 1)
    select py.repo, path as current_path, type as kind, name, start_line, end_line, coalesce(commit_sha, 'unknown') as commit_sha
    from py left join h on h.repo = py.repo"""

ORACLE["tree_scan"] = NUMBERED + PY_CODE + """
    select repo, 'src/' || (l_orderkey % 7) || '/order_' || k || '.py' as path, md5(code) as content_md5, true as valid_utf8
    from o join py_code on path = 'src/order_' || k || '.py' and name = 'Order_' || k"""
ORACLE["index_twice"] = cte("v_commits", "v_repos") + ", " + (NUMBERED + PY).strip()[len("with "):] + """
    , h as (select repo, commit_sha from v_commits qualify row_number() over (partition by repo order by committed_at desc, commit_sha desc) = 1),
    grown as (
        select py.*, o.n, l_orderkey % 7 = 0 as changed from py join o on py.path = 'src/order_' || o.k || '.py'),
    orders_of as (select count(*) as n_all, count(*) filter (l_orderkey % 7 = 0) as n_changed from o)
    select py.repo, coalesce(commit_sha, 'unknown') as commit_sha, path as current_path, type as kind, name, start_line, end_line
    from py left join h on h.repo = py.repo
    union all
    select repo, md5(repo), path, type, name, start_line, case when changed and type = 'class' then end_line + 2 else end_line end
    from grown where repo in (select repo from v_repos)
    union all
    select repo, md5(repo), path, 'function', 'added', 2 * n + 2, 2 * n + 3 from grown where changed and type = 'class'
    union all
    select '', '', '', 'blobs parsed by run ' || run, case run when 1 then n_all when 3 then n_changed else 0 end::varchar, 0, 0
    from orders_of, (values (1), (2), (3)) r(run)"""

# ---- embeddings and search ----


def buckets(rows: str, dim: int) -> str:
    """CTE body: signed word counts per (item_id, bucket), zeros dropped, of `rows` (item_id, text)."""
    return f"""
        select item_id, bucket, cast(sum(sign) as bigint) as value
        from (select item_id, ('0x' || substr(h, 1, 8))::ubigint % {dim} as bucket, case when substr(h, 9, 1) < '8' then 1 else -1 end as sign
              from (select item_id, md5(token) as h
                    from (select item_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+')) as token from {rows})))
        group by item_id, bucket having sum(sign) <> 0"""


ORACLE["embed_documents"] = f"""
    with b as ({buckets("(select doc_id as item_id, text from documents)", 256)})
    select item_id as doc_id, cast(bucket as int) as bucket, value from b"""

ORACLE["embed_zero_fallback"] = f"""
    with b as ({buckets("(select doc_id as item_id, text from documents)", 256)}),
    d as (select doc_id, doc_id % 4 = 3 as failed from documents where trim(text, {SPACES}) <> '')
    select doc_id, failed, case when failed then 1536 else 256 end as width,
           failed or not exists (select 1 from b where b.item_id = d.doc_id) as all_zero
    from d"""

COLLECTIONS = cte("v_commits", "v_prs") + """
    , t as (
        select 'functions' as collection, cast(doc_id as varchar) as item_id, text from documents
        union all select 'commits', commit_sha, message from v_commits
        union all select 'prs', cast(number as varchar), case when state = 'open' then title end from v_prs),
    """ + f"""k as (select collection, collection || '/' || item_id as item_id, text from t where text is not null and trim(text, {SPACES}) <> '')"""

ORACLE["embed_collections"] = COLLECTIONS + f"""
    , b as ({buckets("k", 64)}),
    s as (select split_part(item_id, '/', 1) as collection, sum(value) as total, sum(value * value) as norm from b group by 1)
    select k.collection, count(*) as items, cast(any_value(s.total) as bigint) as total, cast(any_value(s.norm) as bigint) as norm
    from k join s on s.collection = k.collection group by k.collection"""

ORACLE["embed_summary"] = COLLECTIONS + " select collection, count(*) as embedded, cast(0 as bigint) as failed from k group by 1"

ORACLE["index_build"] = """
    select 'vectors' as collection, count(*) as vectors, cast(min(len(embedding)) as int) as dim,
           round(sum(list_sum(list_transform(embedding, lambda x: cast(x as double) * cast(x as double)))), 6) as norms
    from embeddings"""

KNN = """
    with q as (select cast(label as varchar) as query_id, cast(arg_min(embedding, vec_id) as double[]) as qv from embeddings group by label),
    e as (select cast(vec_id as varchar) as item_id, label, cast(embedding as double[]) as ev from embeddings),
    d as (select query_id, item_id, label, list_sum(list_transform(list_zip(qv, ev), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) as distance from q, e),
    r as (select *, cast(row_number() over (partition by query_id order by distance, item_id) as int) as rank from d qualify rank <= 5)"""

ORACLE["knn_exact"] = KNN + " select query_id, rank, item_id, round(distance, 6) as distance from r"
ORACLE["index_search"] = ORACLE["knn_exact"]
ORACLE["knn_items"] = KNN + " select query_id, rank, label, round(distance, 6) as distance from r"

TEXT_KNN = cte("v_items") + f"""
    , ib as ({buckets("v_items", 256)}),
    qb as ({buckets("(select cast(item_id as varchar) as item_id, text from benchmark)", 256)}),
    norms as (select item_id, sum(value * value) as n from ib group by 1),
    qnorms as (select item_id, sum(value * value) as n from qb group by 1),
    dots as (select qb.item_id as query_id, ib.item_id, sum(qb.value * ib.value) as dot from qb join ib using (bucket) group by all),
    pairs as (select qn.item_id as query_id, n.item_id, cast(qn.n as double) as qn, cast(n.n as double) as n from qnorms qn, norms n),
    dist as (select p.query_id, p.item_id, 2 - 2 * cast(coalesce(dot, 0) as double) / sqrt(p.qn * p.n) as distance
             from pairs p left join dots d on d.query_id = p.query_id and d.item_id = p.item_id),
    hits as (select v.collection, v.name, v.text, d.query_id, d.item_id, d.distance,
                    row_number() over (partition by v.collection, d.query_id order by d.distance, d.item_id) as rank
             from dist d join v_items v on v.item_id = d.item_id qualify rank <= 5)"""

ORACLE["knn_collections"] = TEXT_KNN + """
    select collection, query_id, cast(rank as int) as rank, item_id, round(distance, 6) as distance from hits"""

RETRIEVED = TEXT_KNN + """
    , sections as (
        select query_id,
               string_agg(rank || '. ' || coalesce(name, 'unknown') || ': ' || text, chr(10) order by rank) filter (collection = 'functions') as fs,
               string_agg(rank || '. ' || text, chr(10) order by rank) filter (collection = 'commits') as cs,
               string_agg(rank || '. ' || text, chr(10) order by rank) filter (collection = 'prs') as ps
        from hits group by 1),
    contexts as (
        select cast(b.item_id as varchar) as query_id, b.text,
               coalesce(concat_ws(chr(10) || chr(10), 'Functions:' || chr(10) || fs, 'Commits:' || chr(10) || cs, 'PRs:' || chr(10) || ps), '') as context
        from benchmark b left join sections s on s.query_id = cast(b.item_id as varchar))"""

ORACLE["retrieval_context"] = RETRIEVED + " select query_id, context from contexts"
ORACLE["context_fallback"] = RETRIEVED + """
    select query_id, context as shown, false as empty from contexts
    union all
    select 'blank ' || query_id, 'No relevant repository context found.', true from contexts"""
ORACLE["prompts"] = RETRIEVED + """
    select query_id, 'Notes on a code base follow; rely on them alone.' || chr(10) || chr(10) || 'Context:' || chr(10)
           || case when context = '' then 'No relevant repository context found.' else context end
           || chr(10) || chr(10) || 'Question:' || chr(10) || text || chr(10) || chr(10) || 'Answer:' as prompt
    from contexts"""
ORACLE["prompts_stored"] = ORACLE["prompts"]

# ---- contexts and reports ----

PARTS = cte("v_repos", "v_commits", "v_prs", "v_files", "v_symbols") + STATS + COMMITS50 + PRS30 + SYMBOLS200 + FILES50 + """
    , counts as (
        select r.*,
               (select count(*) from c50 c where c.repo = r.repo) as commits_count,
               (select count(*) from p30 p where p.repo = r.repo) as prs_count,
               (select count(*) from v_symbols s where s.repo = r.repo and kind = 'function') as functions_count,
               (select count(*) from v_symbols s where s.repo = r.repo and kind = 'class') as classes_count,
               (select count(*) from v_files f where f.repo = r.repo) as files_count
        from v_repos r)"""

ORACLE["repo_context"] = PARTS + NAMES + """
    , blocks as (
        select repo, string_agg(chr(10) || current_path || ':' || case when functions <> '' then chr(10) || '  Functions: ' || functions else '' end
                                || case when classes <> '' then chr(10) || '  Classes: ' || classes else '' end, chr(10) order by file_rank) as body
        from n10 group by 1),
    cs as (select repo, string_agg('- ' || substr(message, 1, 80) || ' (by ' || author_name || ')', chr(10) order by rank) as body from c50 where rank <= 5 group by 1),
    ps as (select repo, string_agg('- PR #' || number || ': ' || substr(title, 1, 80) || ' (' || state || ')', chr(10) order by rank) as body from p30 where rank <= 5 group by 1),
    texts as (
        select r.repo, concat_ws(chr(10), 'Repository: ' || r.repo, case when description <> '' then 'Description: ' || description end,
                   chr(10) || 'Codebase Statistics:', '- Files: ' || files_count, '- Functions: ' || functions_count, '- Classes: ' || classes_count,
                   '- Commits: ' || commits_count, '- Pull Requests: ' || prs_count,
                   chr(10) || 'Code Structure:' || chr(10) || blocks.body,
                   chr(10) || 'Recent Commits:' || chr(10) || cs.body,
                   chr(10) || 'Recent Pull Requests:' || chr(10) || ps.body) as context
        from counts r left join blocks on blocks.repo = r.repo left join cs on cs.repo = r.repo left join ps on ps.repo = r.repo)
    select repo, context, 'Code base: ' || repo || chr(10) || chr(10) || 'Context:' || chr(10) || context
           || chr(10) || chr(10) || 'Question:' || chr(10) || 'Which files matter most?' || chr(10) || chr(10)
           || 'Name the files, commits or requests behind each point.' as prompt
    from texts"""


def _leaves(degraded: bool) -> str:
    lost = "description = ''" if degraded else "false"
    warning = f", case when {lost} then 'Git not available - code parsing skipped' end as warning" if degraded else ""
    return PARTS + f"""
    , leaves as (
        select repo, 'stats' as section, 1 as position, concat_ws('|', commits_count, prs_count,
               case when {lost} then 0 else functions_count end, case when {lost} then 0 else classes_count end,
               case when {lost} then 0 else files_count end) as leaf from counts
        union all select repo, 'details', 1, concat_ws('|', description, language, stars, forks) from counts
        union all select repo, 'commits', cast(rank as int), concat_ws('|', commit_sha, message, author_name, author_email, strftime(committed_at, {STAMP})) from c50
        union all select repo, 'prs', cast(rank as int), concat_ws('|', number, title, state, user_login, strftime(created_at, {STAMP})) from p30
        union all select s.repo, 'symbols', cast(rank as int), concat_ws('|', current_path, kind, name, start_line, end_line) from s200 s
                  join v_repos r on r.repo = s.repo where not ({lost})
        union all select f.repo, 'file_stats', cast(rank as int), concat_ws('|', current_path, functions, classes) from f50 f
                  join v_repos r on r.repo = f.repo where not ({lost}))
    select repo, section, position, leaf{warning} from leaves join v_repos using (repo)"""


ORACLE["repo_report"] = _leaves(False)
ORACLE["repo_report_degraded"] = _leaves(True)

# ---- streaming ----

ORACLE["stream_ingest"] = """
    select user_id, event_id, event_type, value from events
    qualify row_number() over (partition by user_id order by ts, event_id) = 1"""
