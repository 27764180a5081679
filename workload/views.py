"""The given tables in the shape of lineage tables, in SQL both engines read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SQL = {
    "v_commits": """
        select concat('repo', cast(o.o_custkey % 10 as string)) as repo,
               md5(cast(o.o_orderkey as string)) as commit_sha,
               c.c_name as author_name,
               concat(lower(replace(c.c_name, '#', '.')), '@example.com') as author_email,
               concat(o.o_orderpriority, ' order ', cast(o.o_orderkey as string)) as message,
               cast(o.o_orderdate as timestamp) as committed_at
        from {orders} o join {customer} c on o.o_custkey = c.c_custkey""",
    "v_files": """
        select concat('repo', cast(p_partkey % 10 as string)) as repo,
               p_partkey as file_id,
               concat('src/', replace(p_brand, '#', '_'), '/',
                      case p_partkey % 4 when 0 then 'build/' when 1 then '.cache/' when 2 then 'rebuild/' else '' end,
                      replace(p_name, ' ', '_'), '_', cast(p_partkey as string),
                      case p_partkey % 5 when 0 then '.py' when 1 then '.js' when 2 then '.tsx' when 3 then '.go' else '.md' end) as current_path
        from {part}
        union all
        select concat('repo', cast(s_suppkey % 10 as string)) as repo,
               -1 - s_suppkey as file_id,
               concat('docs/', replace(s_name, '#', '_'), '.md') as current_path
        from {supplier}""",
    "v_symbols": """
        select concat('repo', cast(l_partkey % 10 as string)) as repo,
               l_partkey as file_id,
               md5(cast(l_orderkey as string)) as commit_sha,
               case when l_returnflag = 'R' then 'class' else 'function' end as kind,
               concat(case when l_linestatus = 'O' then 'Load' else 'load' end, '_', cast(l_suppkey as string)) as name,
               l_linenumber * 10 as start_line,
               l_linenumber * 10 + cast(l_quantity as int) as end_line
        from {lineitem}""",
    "v_prs": """
        select concat('repo', cast(user_id % 10 as string)) as repo,
               event_id as number,
               concat(event_type, ' by user ', cast(user_id as string)) as title,
               case when event_type in ('error', 'view') then 'open' else 'closed' end as state,
               concat('user', cast(user_id as string)) as user_login,
               cast(ts as timestamp) as created_at,
               props
        from {events}""",
    "v_repos": """
        select concat('repo', cast(c_custkey % 10 as string)) as repo,
               min(c_mktsegment) as language,
               case when c_custkey % 10 < 5 then concat('Orders ending in ', cast(c_custkey % 10 as string)) else '' end as description,
               count(*) as stars,
               count(distinct c_nationkey) as forks
        from {customer}
        group by c_custkey % 10""",
    "v_items": """
        select case doc_id % 3 when 0 then 'functions' when 1 then 'commits' else 'prs' end as collection,
               cast(doc_id as string) as item_id,
               case when doc_id % 2 = 0 then concat('doc_', cast(doc_id as string)) end as name,
               text
        from {documents}""",
}

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


TEXTS = ("documents", "benchmark", "conversations", "pages")


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf}/{name}.parquet")
    if name in TEXTS and df.rdd.getNumPartitions() < spark.sparkContext.defaultParallelism:
        # A test file is one row group, so one task; a stored table has splits enough for every core.
        df = df.repartition(spark.sparkContext.defaultParallelism)
    return df


def view(spark: SparkSession, sf: str, name: str) -> DataFrame:
    text = SQL[name]
    used = {t: table(spark, sf, t) for t in TABLES if "{" + t + "}" in text}
    return spark.sql(text, **used)


def cte(*names: str) -> str:
    """The named views as a DuckDB WITH clause."""
    plain = {t: t for t in TABLES}
    return "with " + ",\n".join(f"{n} as ({SQL[n].format(**plain)})" for n in names)


def _lines_of_orders(spark: SparkSession, sf: str) -> DataFrame:
    line = F.struct("l_linenumber", "l_partkey", "l_suppkey")
    # As many tasks as a shuffle has: what follows is work of Python or patterns, far more than the bytes by which tasks are joined.
    lines = table(spark, sf, "lineitem").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "l_orderkey")
    return lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(line)).alias("lines"))


def v_code(spark: SparkSession, sf: str, language: str, decorated: bool = False) -> DataFrame:
    """One generated source file per order: (repo, path, content)."""
    key = F.col("l_orderkey").cast("string")

    def member(line, i):
        n, supplier = (i + 1).cast("string"), line["l_suppkey"].cast("string")
        if language == "js":
            return F.concat(F.lit("  const f_"), n, F.lit(" = (x) => {\n    return x * "), supplier, F.lit(";\n  }"))
        head = F.lit("    @cached\n    def m_") if decorated else F.lit("    def m_")
        doc = F.concat(F.lit('        """Supplier '), supplier, F.lit('."""\n')) if decorated else F.lit("")
        return F.concat(head, n, F.lit("(self):\n"), doc, F.lit("        return "), supplier)

    members = F.array_join(F.transform("lines", member), "\n")
    if language == "js":
        content = F.concat(F.lit("class Order_"), key, F.lit(" {\n"), members, F.lit("\n}"))
    else:
        content = F.concat(F.lit("class Order_"), key, F.lit(":\n"), members)
    return _lines_of_orders(spark, sf).select(
        F.concat(F.lit("repo"), (F.col("l_orderkey") % 10).cast("string")).alias("repo"),
        F.concat(F.lit("src/order_"), key, F.lit(f".{language}")).alias("path"),
        content.alias("content"),
    )


#: First lines of the members of `v_scripts`, `#` being the member's number: every definition pattern and
#: label, a rejected name, a comment, a line that gives both, and an arrow without a block.
SCRIPT_FORMS = (
    "function f_#(x) {", "  f_#: function (x) {", "const f_# = function (x) {", "const f_# = (x) => {", "  f_#(x) => {", "  if (x) => {", "class C_# {",
    "interface I_# {", "type T_# = {", "enum E_# {", "class type_# {", "// function f_#(x) {", "class C_# extends g_#(x) => {", "const f_# = (x) => x;",
)


def v_scripts(spark: SparkSession, sf: str) -> DataFrame:
    """One script per order, a member of three lines for each of its lines: (repo, path, content).

    A returned line of an open order is never closed, an accepted one of a finished order once too often.
    """
    line = F.struct("l_linenumber", "l_partkey", "l_suppkey", F.concat("l_returnflag", "l_linestatus").alias("state"))
    lines = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(line)).alias("lines"))
    forms = F.array(*map(F.lit, SCRIPT_FORMS))

    def member(line, i):
        form, state = (line["l_partkey"] % len(SCRIPT_FORMS)).cast("int"), line["state"]
        closed = form != len(SCRIPT_FORMS) - 1
        inner = F.when(closed & (state == "AF"), F.lit("}")).otherwise(F.lit(""))
        last = F.when(closed & (state != "RO"), F.lit("}")).otherwise(F.lit(";"))
        return F.concat(F.replace(F.get(forms, form), F.lit("#"), (i + 1).cast("string")), F.lit("\n  x();"), inner, F.lit("\n"), last)

    key = F.col("l_orderkey").cast("string")
    suffix = F.when(F.col("l_orderkey") % 3 == 0, "js").when(F.col("l_orderkey") % 3 == 1, "ts").otherwise("jsx")
    return lines.select(
        F.concat(F.lit("repo"), (F.col("l_orderkey") % 10).cast("string")).alias("repo"),
        F.concat(F.lit("src/order_"), key, F.lit("."), suffix).alias("path"),
        F.array_join(F.transform("lines", member), "\n").alias("content"),
    )
