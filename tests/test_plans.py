"""Physical plans: what is scanned and what is shuffled."""

import re

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def text_exchanges(df):
    """Exchanges whose rows hold the text, by the columns of the node below; and scans that read it."""
    exchanges = df._jdf.queryExecution().executedPlan()
    found, scans = [], 0

    def walk(node):
        nonlocal scans
        name = node.nodeName()
        names = [node.output().apply(k).name() for k in range(node.output().size())]
        if name.startswith("Exchange") and "text" in names:
            found.append(node.toString().split("\n")[0])
        scans += name.startswith("Scan parquet") and "text" in names
        children = node.children()
        for k in range(children.size()):
            walk(children.apply(k))

    root = exchanges.inputPlan() if exchanges.nodeName() == "AdaptiveSparkPlan" else exchanges
    walk(root)
    return found, scans


@pytest.mark.parametrize("name", ["c9_strip_furniture", "c15_classify_pages", "c17_content_pages", "d6_split_sections", "d11_build_chunks"])
def test_text_of_pages_is_scanned_and_shuffled_once(spark, name):
    """Detection, stripping, numbering, sections and chunks share one scan and one exchange of the text."""
    found, scans = text_exchanges(entry.queries()[name](spark, SF))
    assert scans == 1 and len(found) == 1 and re.search(r"hashpartitioning\(document_id", found[0]), found


@pytest.mark.parametrize("name", ["d6_split_sections", "d11_build_chunks"])
def test_lines_are_sorted_twice_and_dealt_in_bounded_shares(spark, name):
    """Two sorts of lines (by number, by stretch of titles), and an exchange whose shares no one joins to larger ones."""
    text = plan(entry.queries()[name](spark, SF))
    assert len(re.findall(r"Sort \[document_id#\d+ ASC[^]]*line_no", text)) == 2
    assert not re.search(r"Sort \[document_id#\d+ ASC NULLS FIRST\]", text)
    assert re.search(r"hashpartitioning\(document_id#\d+, 16\), REPARTITION_BY_NUM", text)


def test_shares_are_bounded_by_the_splits_of_the_input(spark):
    from passagework.sources.lineage import dealt
    few, many = spark.range(100).coalesce(1), spark.range(100).repartition(10)
    assert dealt(few, "id").rdd.getNumPartitions() == 16 and dealt(many, "id").rdd.getNumPartitions() == 80


def test_a_dropped_tenant_is_not_read(spark):
    """The filter is one of folders: files of the tenant that goes are not listed by the scan."""
    from passagework.plans.lifecycle import tenant_chunks
    from passagework.sources.documents import drop_tenant
    stored = tenant_chunks(spark, SF)
    left = drop_tenant(stored, "src3")
    assert re.search(r"PartitionFilters: \[[^]]*NOT \(tenant#\d+ = src3\)", plan(left)) and "PushedFilters: []" in plan(left)
    files = stored.select("tenant", "document_id", "_metadata.file_path").distinct().collect()
    by_document = {}
    for r in files:
        by_document.setdefault((r.tenant, r.document_id), set()).add(r.file_path)
        assert f"tenant={r.tenant}/" in r.file_path
    assert all(len(paths) == 1 for paths in by_document.values())
