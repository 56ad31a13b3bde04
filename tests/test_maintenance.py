"""Tag repairs."""

from folioworks.functions.spanish import slug
from folioworks.operators import maintenance


def test_a_rival_is_the_smallest_other_claim(spark):
    rows = [(3, "hot anvil", "old-3"), (5, "hot anvil", "old-5"), (9, "hot anvil", "old-9"), (9, "hot anvil", "old-9"),
            (4, "cold iron", "old-4"), (6, "blue tin", "old-6"), (7, "blue tin", "blue-tin"), (8, "  ", "old-8")]
    updates, conflicts = maintenance.tag_updates(spark.createDataFrame(rows, "tag_id long, name string, slug string"), slug)
    assert {(r.tag_id, r.rival) for r in conflicts.collect()} == {(3, 5), (5, 3), (9, 3), (6, 7)}
    assert [(r.tag_id, r.desired) for r in updates.collect()] == [(4, "cold-iron")]
