"""More queries, of lookups, texts, mail and rules, each with its DuckDB SQL; registered with the catalog's."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators import conversation as C
from quern.operators import events as E
from quern.operators import graph as G
from quern.operators import keyed as K
from quern.operators import ordered as O
from quern.operators import rollup as R
from quern.operators import rules as P
from quern.plans.catalog import query, table


def col(name: str, kind: str = "string"):
    return F.col(name).cast(kind)


# --- event logs and calls


@query("""WITH e AS (SELECT user_id, event_id, row_number() OVER w AS n, event_id % 11 <> 0 AS seq_ok, event_id % 3 <> 0 AS hash_ok FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
    SELECT user_id, n AS line_no, CASE WHEN event_id % 13 = 0 THEN 'invalid event' WHEN NOT seq_ok THEN 'invalid sequence' WHEN n > 1 AND NOT coalesce(lag(event_id % 13 = 0) OVER w, false) THEN 'broken hash chain' WHEN NOT hash_ok THEN 'event hash mismatch' END AS fault FROM e WINDOW w AS (PARTITION BY user_id ORDER BY n)""")
def journal_faults(spark, d):
    """A user's events as log lines, none linked to the one before; some lines, numbers and hashes are spoilt."""
    from pyspark.sql import Window

    e = table(spark, d, "events").withColumn("n", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")))
    body = F.concat(F.lit('{"event_type":"'), "event_type", F.lit('","payload":{},"prev_hash":"","sequence":'), F.when(F.col("event_id") % 11 == 0, F.col("n") + 7).otherwise(F.col("n")).cast("string"))
    digest = F.when(F.col("event_id") % 3 == 0, "bad").otherwise(F.sha2(F.concat(body, F.lit("}")), 256))
    line = F.when(F.col("event_id") % 13 == 0, "not an event").otherwise(F.concat(body, F.lit(',"event_hash":"'), digest, F.lit('"}')))
    lines = e.select("user_id", F.col("n").cast("long").alias("line_no"), line.alias("line"), F.lit(True).alias("terminated"))
    return E.verified(lines, "user_id").select("user_id", "line_no", "fault")


@query("SELECT user_id, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS total FROM events GROUP BY 1")
def reducer_totals(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))
    return E.reduced(e, "user_id", "event_id", lambda state, row: state + row["k"], 0, "total long")


@query("""SELECT event_id, 'errors' AS hook FROM events WHERE event_type = 'error' UNION ALL SELECT event_id, 'low' FROM events WHERE event_type = 'click' AND regexp_matches(json_extract_string(props, '$.k'), '^1')
    UNION ALL SELECT min(event_id), 'first' FROM events WHERE event_type = 'purchase' HAVING count(*) > 0""")
def hook_matches(spark, d):
    e = table(spark, d, "events").select("event_id", F.col("event_type").alias("event"), F.lit("t").alias("tool"), F.create_map(F.lit("k"), F.get_json_object("props", "$.k")).alias("args"))
    hooks = [{"ident": "errors", "event": "error"}, {"ident": "low", "event": "click", "condition": "args.k =~ /^1/"}, {"ident": "first", "event": "purchase", "once": True}]
    return P.matching_hooks(e, hooks, "event_id").select("event_id", "hook")


@query("SELECT event_id FROM events WHERE event_type LIKE 'p%' OR CAST(user_id AS VARCHAR) = '7'")
def event_glob_or(spark, d):
    e = table(spark, d, "events").select("event_id", F.col("event_type").alias("event"), F.lit("t").alias("tool"), F.create_map(F.lit("user"), col("user_id")).alias("args"))
    return e.where(P.condition('event ~= p* || args.user == "7"', P.event_field)).select("event_id")


@query("SELECT user_id, list(event_type ORDER BY event_id) AS results FROM events GROUP BY 1")
def results_in_order(spark, d):
    from quern.streaming.streams import in_order

    return in_order(table(spark, d, "events").select("user_id", F.col("event_id").alias("at"), F.col("event_type").alias("result")), "user_id", "at")


@query("SELECT event_id FROM events WHERE event_id >= 100")
def rows_since(spark, d):
    return C.since(table(spark, d, "events"), "event_id", 100).select("event_id")


@query("SELECT event_id FROM events WHERE epoch_ms(ts) > 1705708800000")
def changed_rows(spark, d):
    return C.changed_since(table(spark, d, "events"), "ts", 1_705_708_800_000).select("event_id")


@query("SELECT count(*) >= 5 AS due FROM events WHERE epoch_ms(ts) > 1705708800000")
def run_is_due(spark, d):
    return C.due(table(spark, d, "events"), "ts", 1_705_708_800_000, 1_705_708_800_000, 1_705_708_800_000 + 30 * 86_400_000)


@query("SELECT event_id, CASE WHEN k * 1000 >= 77000 THEN true WHEN k % 5 >= 3 THEN false ELSE k * 1000 >= 67000 END AS compacts FROM (SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)")
def compaction_gates(spark, d):
    e = table(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    return e.select("event_id", O.compaction_gate(F.col("k") * 1000, F.lit(100_000), F.col("k") % 5).alias("compacts"))


@query("SELECT event_id, coalesce(k, 0) + coalesce(user_id, 0) + 3 AS baseline FROM (SELECT event_id, user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)")
def anchor_baselines(spark, d):
    e = table(spark, d, "events")
    return e.select("event_id", R.anchor_baseline(F.get_json_object("props", "$.k").cast("long"), F.col("user_id"), F.lit(None).cast("long"), F.lit(3).cast("long")).alias("baseline"))


# --- lookups between tables


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'OVER' ELSE c_mktsegment END AS c_mktsegment, CASE WHEN c_custkey % 6 = 0 THEN -1.0::DOUBLE ELSE c_acctbal END AS c_acctbal FROM customer")
def overlay_merge(spark, d):
    base = table(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    over = base.where("c_custkey % 3 = 0").select("c_custkey", F.lit("OVER").alias("c_mktsegment"), F.when(F.col("c_custkey") % 6 == 0, -1.0).otherwise(0.0).alias("c_acctbal"))
    return K.overlay(base, over, "c_custkey", {"c_mktsegment": "", "c_acctbal": 0.0})


@query("SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 7 WHEN p_partkey % 5 = 1 THEN 8 WHEN contains(lower(p_type), 'promo') THEN 1000 WHEN contains(lower(p_type), 'econ') THEN 2000 ELSE 3000 END AS size FROM part")
def context_windows(spark, d):
    five = F.col("p_partkey") % 5
    return table(spark, d, "part").select("p_partkey", K.context_window(F.when(five == 0, 7).otherwise(0), F.when(five == 1, 8), F.col("p_type"), [("PROMO", 1000), ("Econ", 2000)], 3000).alias("size"))


@query("SELECT o_orderkey AS k, CASE WHEN o_orderkey % 4 = 0 THEN 'unread' WHEN o_orderkey % 4 = 1 THEN 'modified' ELSE 'fresh' END AS state FROM orders")
def stale_reads(spark, d):
    files = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("m"))
    reads = files.where("k % 4 <> 0").select("k", F.when(F.col("k") % 4 == 1, F.col("m") + 1).otherwise(F.col("m")).alias("m"))
    return K.stale_reads(reads.unionByName(reads.withColumn("m", F.col("m") - 5)), files, "k", "m")


@query("SELECT o_orderkey AS k FROM orders WHERE o_orderkey % 4 IN (0, 1)")
def needs_reload(spark, d):
    now = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("m"))
    return K.needs_reload(now.where("k % 4 <> 0").select("k", F.when(F.col("k") % 4 == 1, F.col("m") + 1).otherwise(F.col("m")).alias("m")), now, "k", "m")


_DOCS = "SELECT doc_id, CASE WHEN doc_id % 4 = 1 THEN upper(text) || '+' ELSE text END AS now, doc_id % 4 AS k, text FROM documents"


@query(f"WITH d AS ({_DOCS}) SELECT doc_id, CASE k WHEN 0 THEN 'created' WHEN 2 THEN 'deleted' WHEN 1 THEN 'changed' ELSE 'same' END AS change FROM d")
def content_changes(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    after = docs.where("doc_id % 4 <> 2").select("doc_id", F.when(F.col("doc_id") % 4 == 1, F.concat(F.upper("text"), F.lit("+"))).otherwise(F.col("text")).alias("text"))
    return K.changes(docs.where("doc_id % 4 <> 0"), after, "doc_id", "text")


@query("SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'delete' WHEN 1 THEN 'write' WHEN 2 THEN 'write' ELSE 'none' END AS action FROM documents")
def restore_actions(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    backups = docs.select("doc_id", F.when(F.col("doc_id") % 4 == 1, F.concat("text", F.lit("+"))).when(F.col("doc_id") % 4 != 0, F.col("text")).alias("text"))
    return K.restored(docs.where("doc_id % 4 <> 2"), backups, "doc_id", "text")


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE CAST(c_custkey AS VARCHAR) END AS ident FROM customer")
def resolve_names(spark, d):
    c = table(spark, d, "customer")
    names = c.select(F.col("c_name").alias("name"), col("c_custkey").alias("ident"))
    asked = c.select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, "nobody").when(F.col("c_custkey") % 3 == 1, F.col("c_name")).otherwise(col("c_custkey")).alias("ask"))
    return K.resolve_name(asked, "ask", names).select("c_custkey", "ident")


@query("SELECT s_suppkey AS agent_id, n_name AS team FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def team_lookup(spark, d):
    s = table(spark, d, "supplier")
    n = table(spark, d, "nation").join(s.groupBy("s_nationkey").agg(F.collect_list("s_suppkey").alias("member_ids")), F.col("n_nationkey") == F.col("s_nationkey"))
    return K.team_of(n.select(F.col("n_name").alias("team"), "member_ids"), s.select(F.col("s_suppkey").alias("agent_id")))


@query("SELECT c_custkey FROM customer WHERE (c_custkey % 5 = 0 OR c_custkey % 7 = 0) AND c_custkey % 2 <> 0")
def chosen_memories(spark, d):
    c = table(spark, d, "customer").select("c_custkey", F.concat(F.lit("dir/"), "c_name").alias("filename"), "c_name")
    names = c.where("c_custkey % 5 = 0").select(F.col("filename").alias("name")).union(c.where("c_custkey % 7 = 0").select("c_name"))
    return K.chosen(c.drop("c_name"), names, c.where("c_custkey % 2 = 0").select("filename")).select("c_custkey")


@query("SELECT o_orderkey AS id FROM orders WHERE o_orderkey % 3 <> 0 AND o_orderkey % 5 <> 0")
def unread_messages(spark, d):
    box = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 3 == 0, True).when(F.col("o_orderkey") % 3 == 1, False).alias("read"))
    return P.unread(box, box.where("id % 5 = 0").select("id")).select("id")


@query("SELECT p_partkey FROM part WHERE p_type NOT IN ('PROMO', 'SMALL') AND p_type <> 'LARGE' AND p_type IN ('ECONOMY', 'STANDARD', 'MEDIUM')")
def allowed_tools(spark, d):
    t = table(spark, d, "part").select("p_partkey", F.col("p_type").alias("name"))
    return P.allowed_tools(t, ["PROMO"], ["SMALL"], ["ECONOMY", "STANDARD", "MEDIUM", "PROMO"], ["LARGE"], []).select("p_partkey")


@query("SELECT p_partkey FROM part WHERE p_type IN ('PROMO', 'SMALL')")
def coordinator_tools(spark, d):
    return P.coordinator_tools(table(spark, d, "part").select("p_partkey", F.col("p_type").alias("name")), True, ["PROMO", "SMALL"]).select("p_partkey")


@query("SELECT n_name AS name FROM nation WHERE n_nationkey < 10 UNION SELECT r_name FROM region")
def teammate_tools(spark, d):
    n = table(spark, d, "nation").select(F.col("n_name").alias("name"))
    base = [r["name"] for r in table(spark, d, "nation").where("n_nationkey < 10").select(F.col("n_name").alias("name")).collect()]
    return P.teammate_tools(n, base, table(spark, d, "region").select(F.col("r_name").alias("name")))


@query("SELECT n_name AS name, CASE n_nationkey WHEN 3 THEN 1 ELSE 0 END AS asked_at FROM nation WHERE n_nationkey IN (3, 8)")
def asked_for_tools(spark, d):
    n = table(spark, d, "nation").select(F.col("n_name").alias("name"), (F.col("n_nationkey") > 1).alias("deferred"), "n_nationkey")
    wanted = [r["name"] for r in n.where("n_nationkey in (3, 8)").orderBy(F.desc("n_nationkey")).select("name").collect()]
    return P.select_deferred(n, F.array(*[F.lit(w) for w in wanted]), "name", "deferred").select("name", "asked_at")


@query("SELECT c_custkey FROM customer WHERE (regexp_matches(c_name, '7$') OR regexp_matches(c_name, '00$')) AND c_acctbal <= 5000")
def stale_names(spark, d):
    return P.stale_names(table(spark, d, "customer"), "c_name", "c_acctbal", ["7$", "00$"], F.lit(5000)).select("c_custkey")


@query("SELECT name FROM (SELECT DISTINCT p_name AS name FROM part WHERE starts_with(p_name, 's') OR starts_with(p_type, 's') ORDER BY 1 LIMIT 8)")
def command_completions(spark, d):
    p = table(spark, d, "part").groupBy(F.col("p_name").alias("name")).agg(F.collect_set("p_type").alias("aliases"))
    return P.completions(p, "s").select("name")


@query("SELECT a.o_orderkey AS sender, b.o_orderkey AS member FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderkey <> b.o_orderkey WHERE a.o_orderpriority = '1-URGENT'")
def broadcast_mail(spark, d):
    """A customer's orders are a team, an urgent one writes to the others: as many messages as members, each."""
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("team"), F.col("o_orderkey").alias("member"), "o_orderpriority")
    return P.broadcast_messages(o.where("o_orderpriority = '1-URGENT'").select("team", F.col("member").alias("sender")), o).select("sender", "member")


@query("SELECT c_custkey AS id, CASE WHEN c_nationkey = 3 AND c_custkey % 2 = 0 THEN 'completed' WHEN c_custkey % 2 = 0 THEN 'running' ELSE 'idle' END AS status FROM customer")
def status_cascade(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), col("c_nationkey").alias("parent_id"), F.when(F.col("c_custkey") % 2 == 0, "running").otherwise("idle").alias("status"))
    return G.cascade(c, "3").select("id", "status")


@query("SELECT o_custkey AS \"before\", o_orderkey AS \"after\" FROM orders WHERE o_orderkey % 2 = 0 UNION SELECT o_custkey + 1, o_orderkey FROM orders WHERE o_orderkey % 3 = 0")
def task_edges(spark, d):
    o = table(spark, d, "orders")
    none = F.array().cast("array<bigint>")
    blocks = o.where("o_orderkey % 2 = 0").select(F.col("o_custkey").alias("id"), F.array("o_orderkey").alias("blocks"), none.alias("blocked_by"))
    return G.task_edges(blocks.unionByName(o.where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("id"), none.alias("blocks"), F.array(F.col("o_custkey") + 1).alias("blocked_by"))))


@query("WITH RECURSIVE w AS (SELECT s_suppkey AS root, s_suppkey AS file, 0 AS depth FROM supplier UNION ALL SELECT w.root, s.s_suppkey, w.depth + 1 FROM w JOIN supplier s ON s.s_suppkey = w.file * 2 AND s.s_suppkey <> w.file WHERE w.depth < 3) SELECT * FROM w")
def include_closure(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("file"))
    return G.includes(s.where("file % 2 = 0 and file > 0").select((F.col("file") / 2).cast("long").alias("file"), F.col("file").alias("target")), s, 3)


@query("SELECT claim, count(*) AS n FROM (SELECT p_name AS claim FROM part UNION ALL SELECT p_type FROM part) GROUP BY 1 HAVING count(*) > 1")
def claimed_names(spark, d):
    return K.unique_names(table(spark, d, "part").select("p_partkey", "p_name", F.array("p_type").alias("also")), "p_partkey", "p_name", "also")


@query("SELECT doc_id, list_sort(list_distinct([lang, source, 'a', lang])) AS both FROM documents")
def sorted_unions(spark, d):
    return table(spark, d, "documents").select("doc_id", K.sorted_union(F.array("lang", "source"), F.array(F.lit("a"), "lang")).alias("both"))


@query("SELECT doc_id, CASE WHEN lang = source THEN [lang] ELSE [lang, source] END AS items FROM documents")
def absent_items(spark, d):
    return table(spark, d, "documents").select("doc_id", K.add_absent(F.array("lang"), F.array("lang", "source")).alias("items"))


@query("SELECT path FROM (SELECT c_name AS path FROM customer WHERE c_custkey % 3 = 0)")
def selected_backups(spark, d):
    c = table(spark, d, "customer").select(F.col("c_name").alias("path"), "c_custkey")
    return K.selected(c, c.where("c_custkey % 3 = 0").select("path"), "path").select("path")


@query("SELECT s_suppkey FROM supplier ORDER BY s_nationkey % 2, s_suppkey")
def models_first(spark, d):
    s = table(spark, d, "supplier").select(F.lpad(col("s_suppkey"), 9, "0").alias("path"), "s_suppkey", "s_nationkey")
    return K.models_first(s, s.where("s_nationkey % 2 = 0").select("path")).select("s_suppkey")


# --- texts


@query("""SELECT c_custkey, regexp_replace(regexp_replace(c_name, '[^A-Za-z0-9_.-]+', '-', 'g'), '^-+|-+$', '', 'g')[1:100] AS safe, regexp_replace(c_name || ' é!', '[^\\p{L}\\p{N}_-]', '', 'g') AS file_id,
    CASE WHEN c_custkey < 60 THEN c_custkey || 's' ELSE (c_custkey // 60) || 'm' || (c_custkey % 60) || 's' END AS elapsed FROM customer""")
def name_forms(spark, d):
    c = table(spark, d, "customer")
    return c.select("c_custkey", T.safe_id(F.col("c_name")).alias("safe"), T.file_id(F.concat("c_name", F.lit(" é!"))).alias("file_id"), T.elapsed(F.lit(0), F.col("c_custkey")).alias("elapsed"))


@query("""SELECT conv_id, turn, CASE WHEN length(text) > 350 THEN text[1:350] || chr(10) || '… (truncated)' ELSE text END AS cut, coalesce(array_to_string(string_split(text, chr(10))[1:2], chr(10)), '') AS first_two,
    CASE WHEN length(text) % 2 = 0 THEN 'q: ' || text ELSE 'plain' || chr(10) || chr(10) || text END AS filled FROM conversations""")
def cut_texts(spark, d):
    c = table(spark, d, "conversations")
    body = F.when(F.length("text") % 2 == 0, "q: $ARGUMENTS").otherwise("plain")
    return c.select("conv_id", "turn", T.cut_tokens(F.col("text"), 100).alias("cut"), T.cut_lines(F.col("text"), 2, 10**9).alias("first_two"), T.placeholder(body, F.col("text")).alias("filled"))


@query("SELECT p_partkey, trim(p_name) AS said, p_type || '/' || p_brand || ' $OTHER' AS filled, CASE WHEN p_partkey % 2 = 0 THEN '${B}' ELSE p_name END || '-${C}' AS env FROM part")
def expanded_texts(spark, d):
    p = table(spark, d, "part")
    tagged = F.concat(F.lit("a <summary> "), "p_name", F.lit(" </summary> b"))
    env = F.concat(F.when(F.col("p_partkey") % 2 == 0, "${A}").otherwise(F.col("p_name")), F.lit("-${C}"))
    return p.select("p_partkey", T.tag_text(tagged).alias("said"), T.expanded(F.lit("$TYPE/$TYPE_BRAND $OTHER"), {"TYPE": F.col("p_type"), "TYPE_BRAND": F.col("p_brand")}).alias("filled"), T.with_env(env, {"A": "${B}", "B": "b"}).alias("env"))


@query("""SELECT p_partkey, CASE WHEN n = 1 THEN replace(p_name, 'e', 'E') ELSE p_name END AS text, CASE WHEN n = 0 THEN 'not found' WHEN n > 1 THEN 'not unique' END AS error, CAST(n AS BIGINT) AS n_found FROM (SELECT p_partkey, p_name, length(p_name) - length(replace(p_name, 'e', '')) AS n FROM part)""")
def single_replacement(spark, d):
    return table(spark, d, "part").select("p_partkey", T.replaced_once(F.col("p_name"), F.lit("e"), F.lit("E")).alias("x")).select("p_partkey", "x.*")


@query("SELECT p_partkey, lower(split_part(p_name, ' ', 1)) AS name, trim(substr(p_name, length(split_part(p_name, ' ', 1)) + 1)) AS args, ['a/' || lower(p_type), 'b'] AS paths FROM part")
def slash_commands(spark, d):
    p = table(spark, d, "part")
    said = F.concat(F.lit("see @a/"), F.lower("p_type"), F.lit(" and @b @b x@c"))
    return p.select("p_partkey", T.slash_command(F.concat(F.lit(" /"), "p_name")).alias("x"), T.path_refs(said).alias("paths")).select("p_partkey", "x.*", "paths")


@query("SELECT page_id, '{\"url\":\"' || url || '\"}' AS object FROM pages")
def json_in_text(spark, d):
    p = table(spark, d, "pages")
    return p.select("page_id", T.json_object(F.concat(F.lit("so: "), F.to_json(F.struct("url")), F.lit(" done"))).alias("object"))


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'ok' WHEN 1 THEN 'no matches' WHEN 2 THEN 'files differ' END AS meaning FROM part")
def exit_meanings(spark, d):
    k = F.col("p_partkey") % 4
    command = F.when(k == 0, "make").when(k == 1, "cat x | grep 'a b'").when(k == 2, "LC_ALL=C /usr/bin/diff a b").otherwise("make all")
    return table(spark, d, "part").select("p_partkey", T.exit_meaning(command, F.when(k == 0, 0).otherwise(1)).alias("meaning"))


@query("SELECT doc_id, 'n' || doc_id AS name, source AS description, CASE WHEN lang IN ('en', 'de') THEN lang ELSE '' END AS type FROM documents")
def frontmatters(spark, d):
    docs = table(spark, d, "documents")
    said = F.concat(F.lit("---\nname: 'n"), col("doc_id"), F.lit("'\ndescription: "), "source", F.lit("\ntype: "), "lang", F.lit("\n---\nname: body\n"), F.substring("text", 1, 50))
    return docs.select("doc_id", T.frontmatter(said, ["en", "de"]).alias("x")).select("doc_id", "x.*")


@query("""SELECT doc_id, 'validation_error' AS issue_type, 'pkg/' || lang || '.py' AS file, doc_id + 1 AS line, 'bad ' || source AS message, 7 AS "column", 'high' AS risk FROM documents
    UNION ALL SELECT doc_id, 'test_failure', 'tests/t.py', 9, 'traceback points to this location', 0, 'high' FROM documents
    UNION ALL SELECT doc_id, 'validation_error', 'tests/t.py', 9, 'in call', 0, 'medium' FROM documents""")
def diagnostics(spark, d):
    docs = table(spark, d, "documents")
    line = F.concat(F.lit("pkg/"), "lang", F.lit(".py:"), (F.col("doc_id") + 1).cast("string"), F.lit(":7: error: bad "), "source")
    said = docs.select("doc_id", F.concat(line, F.lit("\nnoise\n"), line, F.lit("\ntests/t.py:9: in call\n")).alias("said"))
    return T.diagnostics(said, ["doc_id"], "said")


@query("SELECT doc_id, '- [' || lang || '] ' || source || ' (2024-01-01T00:00:00.' || lpad(CAST(doc_id % 1000 AS VARCHAR), 3, '0') || 'Z): ' || lang AS line FROM documents")
def manifest_lines(spark, d):
    return table(spark, d, "documents").select("doc_id", T.manifest_line(F.col("lang"), F.col("source"), F.lit(1_704_067_200_000) + F.col("doc_id") % 1000, F.col("lang")).alias("line"))


@query("SELECT lang, string_agg(source, '/' ORDER BY doc_id) AS joined FROM documents GROUP BY 1")
def ordered_texts(spark, d):
    return T.ordered_text(table(spark, d, "documents").select("lang", "doc_id", "source"), ["lang"], ["doc_id"], "source", "/")


# --- conversations and mail


@query("""WITH r AS (SELECT conv_id, turn, text, role, CASE WHEN role = 'user' THEN 1 ELSE 0 END AS u FROM conversations), g AS (SELECT *, CASE WHEN u = 1 AND lag(u) OVER (PARTITION BY conv_id ORDER BY turn) = 1 THEN 0 ELSE 1 END AS fresh FROM r),
    i AS (SELECT *, sum(fresh) OVER (PARTITION BY conv_id ORDER BY turn) AS island FROM g) SELECT conv_id, min(turn) AS first_at, any_value(role) AS role, count(*) FILTER (role = 'user') AS n_results FROM i WHERE role <> 'system' GROUP BY conv_id, island""")
def merged_results(spark, d):
    """A user's turn stands for a tool's result."""
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.when(F.col("role") == "user", "tool_result").otherwise(F.col("role")).alias("type"), F.col("text").alias("content"), col("turn").alias("tool_use_id"))
    return C.merged_results(rows, ["conv_id"], "turn").select("conv_id", "first_at", "role", F.coalesce(F.size("tool_results"), F.lit(0)).cast("long").alias("n_results")).withColumn("n_results", F.greatest("n_results", F.lit(0)))


@query("SELECT conv_id, bool_or(contains(text, 'stop')) AS shutdown, CASE WHEN bool_or(contains(text, 'stop')) THEN '' ELSE string_agg('From ' || role || ': ' || text, chr(10) ORDER BY turn) END AS prompt FROM conversations GROUP BY 1")
def next_prompts(spark, d):
    mail = table(spark, d, "conversations").select("conv_id", "turn", F.col("role").alias("from_agent"), F.col("text").alias("content"))
    return C.next_prompt(mail, ["conv_id"], "turn", F.contains("content", F.lit("stop")))


@query("SELECT conv_id, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS notice, count(*) AS n_messages FROM conversations GROUP BY 1")
def team_notices(spark, d):
    return C.notifications(table(spark, d, "conversations"), "conv_id", "turn", "text")


@query("SELECT conv_id, turn, text AS summary, [role] AS keep, length(text) AS tokens FROM conversations")
def boundaries(spark, d):
    c = table(spark, d, "conversations")
    made = C.boundary(F.col("text"), F.array("role"), F.length("text"))
    return c.select("conv_id", "turn", C.parsed_boundary(made).alias("b")).select("conv_id", "turn", "b.summary", "b.keep", "b.tokens")


@query("SELECT conv_id, turn, role, text FROM conversations")
def snapshots(spark, d):
    c = table(spark, d, "conversations")
    return c.select("conv_id", "turn", C.snapshot(["role", "text"]).alias("s")).select("conv_id", "turn", C.restored(F.col("s"), "role string, text string").alias("x")).select("conv_id", "turn", "x.*")


@query("""WITH RECURSIVE s AS (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) AS a, CAST(l_quantity AS BIGINT) + l_linenumber AS b FROM lineitem),
    o AS (SELECT l_orderkey, a, b, row_number() OVER (PARTITION BY l_orderkey ORDER BY a, b) AS n FROM s),
    f AS (SELECT l_orderkey, n, a, b, true AS ok, b AS reach FROM o WHERE n = 1 UNION ALL SELECT o.l_orderkey, o.n, o.a, o.b, o.a >= f.reach, CASE WHEN o.a >= f.reach THEN o.b ELSE f.reach END FROM f JOIN o ON o.l_orderkey = f.l_orderkey AND o.n = f.n + 1)
    SELECT l_orderkey, a AS start, b AS stop, ok AS accepted FROM f""")
def accepted_edits(spark, d):
    spans = table(spark, d, "lineitem").select("l_orderkey", F.col("l_quantity").cast("long").alias("start"), (F.col("l_quantity").cast("long") + F.col("l_linenumber")).alias("stop"))
    return O.accepted_intervals(spans, ["l_orderkey"], "start", "stop")


@query("SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY 1, 2")
def drained_once(spark, d):
    """A user's first event of each type, drained twice from the events' files under one checkpoint."""
    import uuid

    from quern.operators.staging import shared
    from quern.streaming import streams as S

    path, out = f"{d}/events.parquet", f"{shared(spark)}/drained-{uuid.uuid4().hex}"
    kinds = "event_id long, user_id long, event_type string"
    for _ in range(2):
        # a file stream takes one file by a pattern only
        stream = spark.readStream.schema(kinds).parquet(f"{path[:-1]}[{path[-1]}]")
        got = S.drained_once(stream, ["user_id", "event_type"], ["event_id"], f"{out}/output", f"{out}/checkpoint")
    return got.select("user_id", "event_type", "event_id")


@query("""WITH e AS (SELECT user_id || '/' || strftime(ts, '%Y-%m-%d') AS stream, event_id AS seq, epoch_ms(ts) AS ms, event_type, props FROM events),
    s AS (SELECT stream, min(seq) FILTER (event_type = 'purchase') AS stop, max(ms) AS last FROM e GROUP BY 1),
    k AS (SELECT e.*, stop FROM e JOIN s USING (stream) WHERE (stop IS NOT NULL OR last + 3600000 < (SELECT max(ms) FROM e) - 600000) AND (stop IS NULL OR seq <= stop)),
    c AS (SELECT stream, seq % 2 AS i, coalesce(max_by('c' || seq, seq) FILTER (event_type = 'click'), '') AS id, max_by(event_type, seq) AS name,
        CASE WHEN count(*) = 1 THEN min(props) ELSE '{}' END AS args FROM k WHERE event_type IN ('click', 'signup') GROUP BY 1, 2),
    j AS (SELECT stream, '[' || string_agg('{"arguments": ' || args || ', "id": "' || id || '", "name": "' || name || '"}', ', ' ORDER BY i) || ']' AS calls FROM c GROUP BY 1),
    t AS (SELECT stream, any_value(stop) AS stop, coalesce(string_agg(props, '' ORDER BY seq) FILTER (event_type = 'view'), '') AS text, coalesce(max(seq) FILTER (seq = stop) % 7, 0) AS output_tokens,
        coalesce(CAST(json_extract_string(max(props) FILTER (seq = stop), '$.k') AS BIGINT), 0) AS input_tokens FROM k GROUP BY 1)
    SELECT stream, text, coalesce(calls, '[]') AS calls, CASE WHEN stop IS NULL THEN 'abandoned' ELSE 'stop' END AS stop_reason, input_tokens, output_tokens FROM t LEFT JOIN j USING (stream)""")
def delta_streams(spark, d):
    """A user's events of a day are a model's answer in deltas: views are text, clicks and sign-ups parts of calls, a
    purchase the end. Drained twice from the events' files under one checkpoint; days without an end are let go."""
    import uuid

    from quern.operators.staging import shared
    from quern.streaming import streams as S

    path, out = f"{d}/events.parquet", f"{shared(spark)}/deltas-{uuid.uuid4().hex}"
    kind, k = F.col("event_type"), F.get_json_object("props", "$.k").cast("long")
    for _ in range(2):
        e = spark.readStream.schema("event_id long, user_id long, event_type string, ts timestamp_ntz, props string").parquet(f"{path[:-1]}[{path[-1]}]")
        deltas = e.select(
            F.concat_ws("/", "user_id", F.date_format("ts", "yyyy-MM-dd")).alias("stream"), F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"),
            F.when(kind == "view", "text").when(kind.isin("click", "signup"), "call").when(kind == "purchase", "end").alias("kind"), F.col("props").alias("text"),
            (F.col("event_id") % 2).cast("int").alias("call_index"), F.when(kind == "click", F.concat(F.lit("c"), col("event_id"))).alias("call_id"), kind.alias("call_name"),
            F.col("props").alias("arguments"), F.lit("stop").alias("stop_reason"), k.alias("input_tokens"), (F.col("event_id") % 7).alias("output_tokens"),
        )
        got = S.drained_fold(deltas, "ts", f"{out}/output", f"{out}/checkpoint")
    return got


@query("""WITH n AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS line_no FROM events)
    SELECT user_id, line_no, event_id, event_type, CASE WHEN event_id % 7 = 0 THEN 'event hash mismatch' END AS fault FROM n""")
def journal_scan(spark, d):
    """A user's events chained into a log of their own, some altered after that, written as text files and read back in
    ranges. A user's log is in one file, as its lines' order has to hold; a file has the logs of many users."""
    import uuid

    from quern.operators.staging import shared

    e = table(spark, d, "events").select(
        "user_id", F.col("event_id").alias("n"), "event_type", F.lit(0).cast("long").alias("timestamp_ns"), F.lit("").alias("trace_id"), col("event_id").alias("tool_call_id"),
        F.lit("").alias("idempotency_key"), F.col("props").alias("payload"),
    )
    heads = spark.range(0).select(F.col("id").alias("user_id"), F.col("id").alias("sequence"), F.lit("").alias("event_hash"))
    lines = E.appended(e, heads, "user_id")
    spoilt = F.get_json_object("line", "$.tool_call_id").cast("long") % 7 == 0
    text = F.when(spoilt, F.replace("line", F.lit('"version":1'), F.lit('"version":2'))).otherwise(F.col("line"))
    folder = f"{shared(spark)}/journals-{uuid.uuid4().hex}"
    E.packed(lines.withColumn("line", text), "user_id").write.text(folder)
    read = E.verified(E.repaired(E.unpacked(E.read_lines(spark, folder))))
    return read.select(col("journal", "long").alias("user_id"), "line_no", F.col("tool_call_id").cast("long").alias("event_id"), "event_type", "fault")


@query("""SELECT conv_id, turn, part, message FROM (SELECT conv_id, turn, 0 AS part, CASE WHEN role = 'assistant' AND turn % 3 = 0 AND text = '' THEN '{"type":"function_call","name":"Read","call_id":"c' || turn || '","arguments":"{}"}'
        ELSE '{"role":"' || role || '","content":' || CAST(to_json(coalesce(text, '')) AS VARCHAR) || '}' END AS message FROM conversations
    UNION ALL SELECT conv_id, turn, 1, '{"type":"function_call","name":"Read","call_id":"c' || turn || '","arguments":"{}"}' FROM conversations WHERE role = 'assistant' AND turn % 3 = 0 AND text <> '')""")
def wire_items(spark, d):
    """Every third turn of an assistant calls a tool."""
    c = table(spark, d, "conversations").withColumnRenamed("text", "content")
    call = F.array(F.struct(F.concat(F.lit("c"), col("turn")).alias("tool_use_id"), F.lit("Read").alias("tool_name"), F.lit("{}").alias("arguments")))
    c = c.withColumn("tool_uses", F.when((F.col("role") == "assistant") & (F.col("turn") % 3 == 0), call))
    c = c.withColumn("tool_results", F.lit(None).cast("array<struct<tool_use_id:string,content:string,is_error:boolean>>"))
    return C.wire(c, "openai").select("conv_id", "turn", "part", "message")
