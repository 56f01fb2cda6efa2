"""Streams with state: routing of scans and assembly of volumes, over restarts, late arrivals and the end of a day."""

from datetime import UTC, datetime, timedelta

import pytest

from beamgrid import model
from beamgrid.streaming import state
from pyspark.sql import functions as F

T0 = datetime(2024, 5, 1, 12, 0, 0, tzinfo=UTC)


class Folder:
    """A folder that files arrive in, and a stream over it that is started anew for each batch."""

    def __init__(self, spark, path, schema, of):
        self.spark, self.path, self.schema, self.of, self.n = spark, str(path), schema, of, 0

    def arrive(self, rows):
        self.n += 1
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.parquet(f"{self.path}/in/{self.n}")
        stream = self.spark.readStream.schema(self.schema).option("recursiveFileLookup", "true").parquet(f"{self.path}/in")
        out = self.of(stream).writeStream.option("checkpointLocation", f"{self.path}/check").trigger(availableNow=True).format("parquet").option("path", f"{self.path}/out")
        state.start(self.spark, out).awaitTermination()
        return self.spark.read.parquet(f"{self.path}/out").collect()


def test_routing_over_restarts_and_days(spark, tmp_path):
    def file(site, n, name, hours=0):
        return (site, T0 + timedelta(hours=hours), n, name)

    folder = Folder(spark, tmp_path, "site string, time timestamp, file_order long, scan_name string", lambda s: state.route_arrivals(s, "1 hour"))
    folder.arrive([file("a", 1, "CIRC"), file("a", 3, "RHI_A"), file("b", 1, "CIRL"), file(None, 1, None)])
    folder.arrive([file("a", 5, "x_VOL2"), file("a", 4, "PICCOLO_LONG"), file("a", 6, "CIRC"), file("b", 2, "CIRC"), file("a", 7, "TEST")])
    # the state is read again: volume 2 goes on in site a; a file that arrives late is compared by its number
    folder.arrive([file("a", 8, "CIRC"), file("b", 3, "CIRC"), file("a", 2, "CIRC")])
    # the next day begins anew, and the watermark ends the day before
    folder.arrive([file("a", 9, "CIRC", 24)])
    out = folder.arrive([file("a", 10, "CIRC", 40)])
    got = {(r.site, r.file_order): r.product for r in out}
    assert got == {
        ("a", 1): "volume1", ("a", 3): "rhi", ("b", 1): "volume1", ("", 1): "none", ("a", 5): "volume2", ("a", 4): "volume1", ("a", 6): "volume2", ("b", 2): "volume1",
        ("a", 7): "none", ("a", 8): "volume2", ("b", 3): "volume1", ("a", 2): "volume1", ("a", 9): "volume1", ("a", 10): "volume1",
    }


def ray(merged, wanted, file, n, seconds):
    return (merged, wanted, file, n, T0 + timedelta(seconds=seconds))


def test_assembly_complete_late_and_overdue(spark, tmp_path):
    folder = Folder(spark, tmp_path, "merged string, n_sweeps int, volume_id string, ray_idx int, time timestamp", lambda s: state.assemble_sweeps(s, "1 minute", 300_000))
    assert folder.arrive([ray("v", 2, "s2", 0, 10), ray("v", 2, "s2", 1, 11), ray("w", 3, "t1", 0, 0), ray("u", None, "x", 0, 5)]) == []
    out = folder.arrive([ray("v", 2, "s1", 0, 0), ray("v", 2, "s1", 1, 10)])
    got = {(r.volume_id, r.ray_idx): (r.new_ray, r.new_sweep, r.state) for r in out}
    assert got == {("s1", 0): (0, 0, "complete"), ("s1", 1): (1, 0, "complete"), ("s2", 0): (2, 1, "complete"), ("s2", 1): (3, 1, "complete")}
    out = folder.arrive([ray("v", 2, "s3", 0, 20)])
    assert [(r.volume_id, r.new_ray, r.state) for r in out if r.state == "late"] == [("s3", None, "late")]
    # the watermark passes the patience: what came of w and u is given out as it is
    folder.arrive([ray("later", 1, "z", 0, 3600)])
    out = folder.arrive([ray("later still", 1, "y", 0, 3700)])
    assert {(r.merged, r.volume_id, r.new_ray, r.state) for r in out if r.state == "overdue"} == {("w", "t1", 0, "overdue"), ("u", "x", 0, "overdue")}
    assert len(out) == 9


def test_assembly_numbers_as_at_rest(spark, tmp_path):
    rows = [ray(f"m{f % 3}", 4, f"f{f:02d}", n, (n * 7 + f * 3) % 20) for f in range(12) for n in range(5)]
    folder = Folder(spark, tmp_path, "merged string, n_sweeps int, volume_id string, ray_idx int, time timestamp", state.assemble_sweeps)
    for k in range(3):
        out = folder.arrive([r for r in rows if int(r[2][1:]) * 5 % 3 == k or (k == 2 and r[2] == "none")] if k else [r for r in rows if int(r[2][1:]) * 5 % 3 == 0])
    rest = model.number_rays(spark.createDataFrame(rows, folder.schema), F.col("merged"))
    key = lambda r: (r.merged, r.volume_id, r.ray_idx, r.new_ray, r.new_sweep)
    assert sorted(map(key, out)) == sorted(map(key, rest.collect()))


@pytest.mark.parametrize("by", [None, ["site"]])
def test_route_scans_by_site(spark, by):
    from beamgrid.operators import qc

    rows = [("a", 1, "CIRC"), ("a", 2, "VOL2"), ("b", 3, "CIRC"), ("a", 4, "CIRC"), (None, 5, "CIRC")]
    out = {r.file_order: r.product for r in qc.route_scans(spark.createDataFrame(rows, "site string, file_order int, scan_name string"), by).collect()}
    assert out == {1: "volume1", 2: "volume2", 3: "volume1" if by else "volume2", 4: "volume2", 5: "volume1" if by else "volume2"}
