"""Commit-shaped views over the driver's tables.

The reference works on commit / file-change tables mined from git.  The test
tables are TPC-H-like, so these views derive commit-shaped data from them.
Each view has a Spark builder and the same definition as DuckDB SQL (used only
by the oracle in ``__spark_entry__.oracle_sql``).  All are joins, aggregates
and expressions; the window-free self-join on (key, seq - 1) replaces ``lag``
so that no single conversation or commit has to sit in one window partition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import Tables

NL = "\n"

# ---------------------------------------------------------------- Spark side


def v_file(t: Tables) -> DataFrame:
    """One row per (commit, file): hash = order, path from the part, pos = line number."""
    li = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey")
    pa = t.part.select("p_partkey", "p_type", "p_name")
    m = F.col("l_partkey") % 4
    ext = (F.when(m == 0, ".py").when(m == 1, ".md").when(m == 2, ".tar.gz").otherwise(""))
    return (li.join(pa, li.l_partkey == pa.p_partkey)
              .select(F.col("l_orderkey").alias("hash"),
                      F.col("l_linenumber").alias("file_pos"),
                      F.concat(F.col("p_type"), F.lit("/"), F.col("p_name"), ext).alias("path")))


def v_commit(t: Tables) -> DataFrame:
    """One row per commit: message, parents, commit time, branch."""
    k = F.col("o_orderkey")
    m = k % 5
    suffix = (F.when(m == 0, " Fix" + NL + "issue").when(m == 1, " fall" + NL + "back")
               .when(m == 2, " Add feature").when(m == 3, "  CHANGE docs \r").otherwise(""))
    parents = (F.when(k % 13 == 0, F.array().cast("array<bigint>"))
                .when(k % 7 == 0, F.array(k - 1, k - 2))
                .otherwise(F.array(k - 1)))
    return t.orders.select(
        k.alias("hash"),
        F.concat(F.col("o_orderpriority"), suffix).alias("message"),
        parents.alias("parents"),
        F.col("o_orderdate").alias("committed_at"),
        F.when(k % 11 == 0, "dev").otherwise("main").alias("branch"))


def _turn_path(turn, deleted_as_null: bool = True):
    m = turn % 5
    last = F.lit(None).cast("string") if deleted_as_null else F.lit("gone.txt")
    return (F.when(m == 0, "t/test_x.txt").when(m == 1, "README.md").when(m == 2, "LICENSE")
             .when(m == 3, "main.txt").otherwise(last))


def v_change(t: Tables) -> DataFrame:
    """One row per (conversation, turn) as a file change: before = previous turn's text."""
    c = t.conversations.select("conv_id", "turn", "role", "text")
    p = t.conversations.select(F.col("conv_id").alias("p_conv"), (F.col("turn") + 1).alias("p_next"),
                               F.col("text").alias("p_text"))
    j = c.join(p, (c.conv_id == p.p_conv) & (c.turn == p.p_next), "left")
    turn = F.col("turn")
    old = (F.when(turn == 0, F.lit(None).cast("string")).when(turn % 3 == 1, F.lit(""))
            .otherwise(F.concat(F.lit("src/"), _turn_path(turn - 1, deleted_as_null=False))))
    return j.select(F.col("conv_id").alias("hash"), turn.alias("seq"), "role",
                    _turn_path(turn).alias("path"), old.alias("old_path"),
                    F.coalesce(F.col("p_text"), F.lit("")).alias("before"),
                    F.col("text").alias("after"))


def _signed_block(c, sign):
    return F.concat(F.lit(sign), F.replace(c, F.lit(NL), F.lit(NL + sign)))


def v_diff(t: Tables) -> DataFrame:
    """v_change plus a unified diff text and a JSON rendering of its line sets."""
    from ..functions.text import lines
    ch = v_change(t)
    hdr = F.concat(F.lit("--- a/"), F.coalesce("old_path", F.lit("")), F.lit(NL + "+++ b/"),
                   F.coalesce("path", F.lit("")), F.lit(NL))
    diff = F.concat(hdr, F.lit("@@ -1 +1 @@" + NL), _signed_block(F.col("before"), "-"),
                    F.lit(NL + "@@ -2 +2 @@" + NL), _signed_block(F.col("after"), "+"))

    def numbered(c):
        return F.transform(lines(F.col(c)), lambda x, i: F.struct((i + 1).alias("n"), x.alias("line")))

    hist = F.to_json(F.struct(numbered("after").alias("added"), numbered("before").alias("deleted")))
    hist = F.when(F.col("seq") % 6 == 5, F.concat(F.lit("{"), hist)).otherwise(hist)
    return ch.select("*", diff.alias("diff"), hist.alias("diff_hist"))


def v_score(t: Tables) -> DataFrame:
    """Four vectors per group: diff, developer, model and rewritten message."""
    e = t.embeddings.select("vec_id", "embedding")
    role = F.col("vec_id") % 4

    def pick(r):
        return F.first(F.when(role == r, F.col("embedding")), ignorenulls=True)

    return (e.groupBy(F.expr("vec_id div 4").alias("grp"))
             .agg(pick(0).alias("diff_vec"), pick(1).alias("dev_vec"),
                  pick(2).alias("model_vec"), pick(3).alias("rect_vec")))


def _code_line(ln, q):
    m = ln % 4
    return (F.when(m == 0, F.concat(F.lit("    if x > "), q, F.lit(": x = x - 1")))
             .when(m == 1, F.concat(F.lit("    for i in range("), q, F.lit("): x = x + i")))
             .when(m == 2, F.concat(F.lit("    # note "), q))
             .otherwise(F.concat(F.lit("    x = x + "), q)))


def v_code(t: Tables) -> DataFrame:
    """One small Python function per order, before and after its last line item."""
    li = t.lineitem.select("l_orderkey", "l_linenumber",
                           F.floor("l_quantity").cast("string").alias("q"))
    li = li.select("l_orderkey", "l_linenumber", _code_line(F.col("l_linenumber"), F.col("q")).alias("line"))
    g = li.groupBy("l_orderkey").agg(
        F.collect_list(F.struct("l_linenumber", "line")).alias("ls"),
        F.max("l_linenumber").alias("mx"), F.count(F.lit(1)).alias("n"))
    head = F.concat(F.lit("def f"), F.col("l_orderkey").cast("string"), F.lit("(x):"))
    tail = F.lit("    return x")
    after = F.array_sort(F.transform("ls", lambda s: s["line"]))
    before = F.array_sort(F.transform(F.filter("ls", lambda s: s["l_linenumber"] < F.col("mx")),
                                      lambda s: s["line"]))
    return g.select(F.col("l_orderkey").alias("hash"),
                    F.when(F.col("n") == 1, F.lit("")).otherwise(F.concat_ws(NL, head, before, tail)).alias("before"),
                    F.concat_ws(NL, head, after, tail).alias("after"))


def v_edit(t: Tables) -> DataFrame:
    """One row per document as an edited file: lines turned, reversed, or dropped and repeated."""
    ls, k = F.split("text", NL), F.col("doc_id")
    n = F.size(ls)
    after = (F.when(k % 3 == 0, F.concat(F.slice(ls, 3, n), F.slice(ls, 1, 2), F.array(F.concat(F.lit("new "), k.cast("string")))))
              .when(k % 3 == 1, F.reverse(ls)).otherwise(F.concat(F.filter(ls, lambda x, i: i % 5 != 4), F.slice(ls, 1, 3))))
    return t.documents.where("text IS NOT NULL").select("doc_id", F.col("text").alias("before"), F.array_join(after, NL).alias("after"))


def v_branch(t: Tables) -> DataFrame:
    """One row per commit with its first parent: runs of commits, side branches off the third commit before, a few beginnings."""
    k = F.col("o_orderkey")
    return t.orders.select(k.alias("hash"), F.when(k % 13 == 0, None).when(k % 5 == 0, k - 3).otherwise(k - 1).alias("parent"))


def v_version(t: Tables) -> DataFrame:
    """One row per (commit, file): the file's text there, null where the commit deletes it."""
    path = F.concat(F.lit("src/f"), (F.col("l_partkey") % 40).cast("string"), F.lit(".py"))
    g = t.lineitem.groupBy(F.col("l_orderkey").alias("hash"), path.alias("path")).agg(F.max("l_partkey").alias("p"), F.min("l_linenumber").alias("n"))
    return g.select("hash", "path", F.when(F.col("n") % 6 != 5, F.concat(F.lit("part "), F.col("p").cast("string"), F.lit(NL + "line "), F.col("n").cast("string"))).alias("content"))


def v_nested(t: Tables) -> DataFrame:
    """One source text per order: a class with one method per line item, some with a function inside or a head over two lines."""
    def method(n):
        name, m = n.cast("string"), n % 3
        return (F.when(m == 0, F.concat(F.lit("    def m"), name, F.lit("(self, a):\n        if a and self:\n            return a\n        while a: a -= 1")))
                .when(m == 1, F.concat(F.lit("    def m"), name, F.lit("(self):\n\n        def inner"), name,
                                       F.lit("(b):\n            for i in b:\n                pass\n        return b")))
                .otherwise(F.concat(F.lit("    def m"), name, F.lit("(self, s=(1,\n  2)):\n        x = 'if or for'  # while\n        return x"))))

    g = t.lineitem.groupBy("l_orderkey").agg(F.array_sort(F.collect_list("l_linenumber")).alias("ns"))
    ms = F.transform("ns", method)
    return g.select(F.col("l_orderkey").alias("hash"), F.concat(F.lit("class C"), F.col("l_orderkey").cast("string"), F.lit(":\n"), F.array_join(ms, "\n\n")).alias("source"))


# ---------------------------------------------------------------- SQL side (oracle)

SQL_LINES = ("(CASE WHEN {x} = '' THEN []::VARCHAR[] ELSE string_split(CASE WHEN right({x}, 1) = chr(10) "
             "THEN left({x}, length({x}) - 1) ELSE {x} END, chr(10)) END)")


def sql_lines(x: str) -> str:
    return SQL_LINES.format(x=x)


SQL_VIEWS = {
    "v_file": """
SELECT l.l_orderkey AS hash, l.l_linenumber AS file_pos,
       p.p_type || '/' || p.p_name || CASE l.l_partkey % 4 WHEN 0 THEN '.py' WHEN 1 THEN '.md'
            WHEN 2 THEN '.tar.gz' ELSE '' END AS path
FROM lineitem l JOIN part p ON p.p_partkey = l.l_partkey""",
    "v_commit": """
SELECT o_orderkey AS hash,
       o_orderpriority || CASE o_orderkey % 5 WHEN 0 THEN ' Fix' || chr(10) || 'issue'
            WHEN 1 THEN ' fall' || chr(10) || 'back' WHEN 2 THEN ' Add feature'
            WHEN 3 THEN '  CHANGE docs ' || chr(13) ELSE '' END AS message,
       CASE WHEN o_orderkey % 13 = 0 THEN []::BIGINT[] WHEN o_orderkey % 7 = 0
            THEN [o_orderkey - 1, o_orderkey - 2] ELSE [o_orderkey - 1] END AS parents,
       o_orderdate AS committed_at,
       CASE WHEN o_orderkey % 11 = 0 THEN 'dev' ELSE 'main' END AS branch
FROM orders""",
    "v_change": """
SELECT c.conv_id AS hash, c.turn AS seq, c.role,
       CASE c.turn % 5 WHEN 0 THEN 't/test_x.txt' WHEN 1 THEN 'README.md' WHEN 2 THEN 'LICENSE'
            WHEN 3 THEN 'main.txt' ELSE NULL END AS path,
       CASE WHEN c.turn = 0 THEN NULL WHEN c.turn % 3 = 1 THEN ''
            ELSE 'src/' || CASE (c.turn - 1) % 5 WHEN 0 THEN 't/test_x.txt' WHEN 1 THEN 'README.md'
                 WHEN 2 THEN 'LICENSE' WHEN 3 THEN 'main.txt' ELSE 'gone.txt' END END AS old_path,
       coalesce(p.text, '') AS before, c.text AS after
FROM conversations c LEFT JOIN conversations p ON p.conv_id = c.conv_id AND p.turn + 1 = c.turn""",
    "v_diff": """
SELECT *,
       '--- a/' || coalesce(old_path, '') || chr(10) || '+++ b/' || coalesce(path, '') || chr(10)
       || '@@ -1 +1 @@' || chr(10) || '-' || replace(before, chr(10), chr(10) || '-')
       || chr(10) || '@@ -2 +2 @@' || chr(10) || '+' || replace(after, chr(10), chr(10) || '+') AS diff,
       CASE WHEN seq % 6 = 5 THEN '{' ELSE '' END || '{}' AS diff_hist
FROM v_change""",
    "v_score": """
SELECT vec_id // 4 AS grp,
       first(embedding) FILTER (WHERE vec_id % 4 = 0) AS diff_vec,
       first(embedding) FILTER (WHERE vec_id % 4 = 1) AS dev_vec,
       first(embedding) FILTER (WHERE vec_id % 4 = 2) AS model_vec,
       first(embedding) FILTER (WHERE vec_id % 4 = 3) AS rect_vec
FROM embeddings GROUP BY vec_id // 4""",
    "v_edit": """
SELECT doc_id, text AS before, array_to_string(CASE doc_id % 3 WHEN 0 THEN ls[3:] || ls[1:2] || ['new ' || doc_id] WHEN 1 THEN list_reverse(ls)
       ELSE [x FOR x, i IN ls IF i % 5 <> 0] || ls[1:3] END, chr(10)) AS after
FROM (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL)""",
    "v_branch": """
SELECT o_orderkey AS hash, CASE WHEN o_orderkey % 13 = 0 THEN NULL WHEN o_orderkey % 5 = 0 THEN o_orderkey - 3 ELSE o_orderkey - 1 END AS parent
FROM orders""",
    "v_version": """
SELECT l_orderkey AS hash, 'src/f' || (l_partkey % 40) || '.py' AS path,
       CASE WHEN min(l_linenumber) % 6 <> 5 THEN 'part ' || max(l_partkey) || chr(10) || 'line ' || min(l_linenumber) END AS content
FROM lineitem GROUP BY 1, 2""",
    "v_code": """
SELECT hash,
       CASE WHEN n = 1 THEN '' ELSE concat_ws(chr(10), 'def f' || hash || '(x):', before_body, '    return x') END AS before,
       concat_ws(chr(10), 'def f' || hash || '(x):', after_body, '    return x') AS after
FROM (
  SELECT l_orderkey AS hash, count(*) AS n,
         string_agg(line, chr(10) ORDER BY line) AS after_body,
         string_agg(line, chr(10) ORDER BY line) FILTER (WHERE l_linenumber < mx) AS before_body
  FROM (
    SELECT l_orderkey, l_linenumber, max(l_linenumber) OVER (PARTITION BY l_orderkey) AS mx,
           CASE l_linenumber % 4
             WHEN 0 THEN '    if x > ' || CAST(floor(l_quantity) AS BIGINT) || ': x = x - 1'
             WHEN 1 THEN '    for i in range(' || CAST(floor(l_quantity) AS BIGINT) || '): x = x + i'
             WHEN 2 THEN '    # note ' || CAST(floor(l_quantity) AS BIGINT)
             ELSE '    x = x + ' || CAST(floor(l_quantity) AS BIGINT) END AS line
    FROM lineitem) s
  GROUP BY l_orderkey) g""",
}

# Views that other views depend on, in definition order.
_DEPS = {"v_diff": ["v_change"]}


def with_views(sql: str, *names: str) -> str:
    """Prefix ``sql`` with a WITH clause defining the named views (and their dependencies)."""
    order: list[str] = []
    for n in names:
        for d in _DEPS.get(n, []) + [n]:
            if d not in order:
                order.append(d)
    if not order:
        return sql.strip()
    ctes = ",\n".join(f"{n} AS ({SQL_VIEWS[n].strip()})" for n in order)
    body = sql.strip()
    if body[:14].upper() == "WITH RECURSIVE":
        return f"WITH RECURSIVE {ctes},\n{body[14:].lstrip()}"
    if body[:4].upper() == "WITH":
        return f"WITH {ctes},\n{body[4:].lstrip()}"
    return f"WITH {ctes}\n{body}"
