"""Plans and memory of steps that larger tables would break."""

from pyspark.sql import functions as F

from tidemark.operators import differences, traversal
from tidemark.plans import composites
from tidemark.sources import pages

SF = "/root/testdata/sf0.001"


def test_policies_are_written_out_before_monitors_meet_them(spark):
    plan = composites.policy_entries(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    above, below = plan.split("Join ", 1)
    assert "array_join" in below and "array_join" not in above


def test_only_indexes_that_are_opened_are_laid_out(spark):
    day = "2024-01-15"
    roots = spark.createDataFrame([(1, "https://a.org", "https://a.org/r.xml", False)], "site_id long, origin string, url string, baseline boolean")
    held = [("https://a.org/r.xml", k, f"https://a.org/i{k}.xml", day) for k in range(4)] + [(f"https://a.org/i{k}.xml", j, f"https://a.org/i{k}-{j}.xml", day) for k in range(4) for j in range(3)]
    entries = spark.createDataFrame(held, "parent string, pos long, loc string, lastmod string")
    documents = entries.select("parent", F.col("loc").alias("url"), F.when(F.col("loc").contains("-"), "sitemap").otherwise("sitemap-index").alias("kind"))
    marks = spark.createDataFrame([], "url string, mark string")
    asked = []

    def of(table):
        def fetched(parents):
            asked.append(sorted(r.parent for r in parents.collect()))
            return table.join(parents, "parent", "left_semi")

        return fetched

    rows = lambda df: sorted(map(tuple, df.collect()), key=str)
    walk = lambda e, d: rows(traversal.traverse(roots, e, d, marks, "2024-01-12", depth=2, children=2, fetches=4))
    assert walk(of(entries), of(documents)) == walk(entries, documents.drop("parent"))
    opened = [["https://a.org/r.xml"], ["https://a.org/i0.xml", "https://a.org/i1.xml"]]
    assert asked == [opened[0]] * 2 + [opened[1]] * 2  # two of the four indexes are opened


def test_patches_leave_in_pieces(spark):
    long = "".join(f"{k}\n" for k in range(300_000))
    pairs = [(k, "2024", old, new) for k, (old, new) in enumerate([("", long), (None, "a"), ("a\nb", "a\n"), ("x", "x"), (long, None), (None, None), ("b", None)])]
    df = spark.createDataFrame(pairs, "k int, day string, old string, new string").coalesce(1)
    out = differences.edited(df, "old", "new", breaks=True)
    want = [(k, day, *differences.edit(old, new, breaks=True)) for k, day, old, new in pairs]
    assert sorted(map(tuple, out.collect())) == want and min(len(want[0][4]), len(want[4][4])) > 2 * differences.PIECE // 2
    assert want[2][2:4] == (0, 1) and want[5][2:] == (0, 0, "")
    assert "ArrowEvalPython" not in differences.text_changes(df, "k", "old", "new")._jdf.queryExecution().toString()  # holds a whole batch's texts and patches


def test_pages_are_parsed_once_for_all_steps(spark):
    html = spark.createDataFrame([(1, "<div><p><b>x</b></p><p>y</p></div>"), (2, None)], "k int, html string")
    out = pages.select_elements(pages.elements(html, "k", "html"), "k", "div > p b, p + p, div p")
    assert "ArrowEvalPython" not in out._jdf.queryExecution().toString()
    assert sorted((r.k, r.pre) for r in out.collect()) == [(1, 1), (1, 2), (1, 3)]
