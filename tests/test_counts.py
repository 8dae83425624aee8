import datetime as dt
import random

from pyspark.sql import functions as F

from lantern.operators import counts, mutations
from lantern.plans import commands
from lantern.plans.params import Caller
from lantern.sources.schema import inline
from lantern.sources.shared import written
from tests.conftest import YEAR, event

ADMIN = Caller(1, "ADMIN")


def rows_of(df):
    return sorted(map(tuple, df.collect()))


def test_equal_to_a_recount_after_random_changes(spark, tables, tmp_path):
    rng = random.Random(5)
    kinds, folder = counts.catalogue_kinds(), f"file://{tmp_path}"
    status = lambda: rng.choice(["APPROVED", "PENDING", "REJECTED"])
    t = tables | {"events": inline(spark, "events", [event(i, status=status(), createdById=rng.randint(1, 3), categoryId=rng.randint(1, 5)) for i in range(1, 60)])}
    stored = counts.counted(t["events"], kinds)
    for step in range(6):
        before, ids = t["events"], rng.sample(range(1, 75), 8)
        if step % 6 == 0:  # created
            ids = [100 + step, 101 + step]
            after = mutations.inserted(before, inline(spark, "events", [event(i, status="PENDING", categoryId=2) for i in ids]))
        elif step == 1:  # deleted, some of them not there
            after = mutations.deleted(before, spark.createDataFrame([(i,) for i in ids], "id int"))
        elif step == 2:  # moderated
            ids = [r["id"] for r in before.where("status = 'PENDING'").orderBy("id").limit(1).collect()]
            after = commands.moderate(t, ids[0], "approve", ADMIN)["events"]
        elif step == 3:  # an author's edit goes back to the queue
            own = before.where("createdById = 3 AND status <> 'PENDING'").orderBy("id").first()["id"]
            ids = [own, own]
            after = commands.edit(t, own, spark.createDataFrame([("new", 4)], "title string, categoryId int"), Caller(3))["events"]
        else:  # moved to other authors and categories
            after = mutations.updated(before, spark.createDataFrame([(i, rng.randint(1, 3), rng.randint(1, 5)) for i in ids], "id int, createdById int, categoryId int"))
        after = written(after, folder, f"events{step}")
        change = counts.change(before, after, spark.createDataFrame([(i,) for i in ids], "id int"), kinds)
        stored = written(counts.kept(stored, change), folder, f"counts{step}")
        assert rows_of(stored) == rows_of(counts.counted(after, kinds)), step
        t = t | {"events": after}
    got = {r["id"]: r["count"] for r in counts.of(stored, "author", t["users"]).collect()}
    assert got == {u: t["events"].where(F.col("createdById") == u).count() for u in (1, 2, 3)}
    queue = stored.where("kind = 'queue'").first()["n"]
    assert queue == t["events"].where("status = 'PENDING'").count() and dt.date(YEAR, 1, 1)
    # two changes at once, and everything deleted
    gone = counts.change(t["events"], t["events"].limit(0), t["events"].select("id"), kinds)
    assert rows_of(counts.kept(stored, gone)) == [] and rows_of(counts.change(t["events"], t["events"], t["events"].select("id"), kinds)) == []
