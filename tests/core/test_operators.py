"""Table operators: dedup, delta, packages, encryption, archives, streams."""

import io
import math
import random
import struct
import zipfile
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from packsmith import errors
from packsmith.functions import codecs, race, scalars, transforms
from packsmith.operators import dedup, delta, pack, profile
from packsmith.session import scratch, shared_dir, stored
from packsmith.sources import archives, items
from packsmith.streaming import dedup as streaming
from packsmith.streaming import progress

SCHEMA = "item_id bigint, path string, content binary, length bigint"
rng = random.Random(42)


def frame(spark, rows):
    return spark.createDataFrame([(i, p, c, len(c)) for i, p, c in rows], SCHEMA)


def test_profile(spark):
    got = {r.item_id: r for r in profile.profile(frame(spark, [(1, "a", b""), (2, "b", b"x" * 5000), (3, "c", rng.randbytes(20000))])).collect()}
    assert (got[1].entropy, got[1].verdict) == (0.0, "compressible") and got[2].entropy == 0.0
    assert got[3].entropy > 7.6 and got[3].verdict == "incompressible"


def test_chunks_restore_and_store(spark):
    block = rng.randbytes(3000)
    docs = frame(spark, [(1, "a", bytes(12000)), (2, "b", b""), (3, "c", block * 4 + b"tail"), (4, "d", b"abc")])
    pieces = stored(dedup.chunks(docs, 64, 256, 1024), "pieces")
    back = dedup.restore(dedup.manifest(pieces), dedup.first_pieces(pieces), docs)
    assert {r.item_id: bytes(r.content) for r in back.collect()} == {r.item_id: bytes(r.content) for r in docs.collect()}
    lost = dedup.restore(dedup.manifest(pieces), dedup.first_pieces(pieces).where("item_id <> 4"), docs).where("item_id = 4").first()
    assert lost.content is None and lost.error_class == "CorruptPackageError"
    stats = dedup.dedup_stats(pieces).first()
    assert stats.total_bytes == 24007 and stats.unique_bytes < 13000
    assert dedup.dedup_stats(pieces.where("false")).first().dedup_ratio == 1.0
    per = {r.item_id: r for r in dedup.item_dedup_stats(pieces).collect()}
    assert per[4].dedup_ratio == 1.0 and per[1].chunks > per[1].unique_chunks
    store = dedup.BlobStore(spark, scratch(spark, "blobs"))
    assert store.count() == 0
    store.put(pieces)
    n = store.count()
    store.put(pieces)
    assert store.count() == n == stats.unique_chunks
    asked = spark.createDataFrame([(pieces.first().sha,), ("nothing",)], "sha string")
    assert sorted(r.found for r in store.get(asked).collect()) == [False, True] and store.contains(asked).count() == 1


def test_delta(spark):
    block = rng.randbytes(40_000)
    old, new = frame(spark, [(1, "a", block + b"old tail" * 300)]), frame(spark, [(1, "a", block + b"new tail!" * 300)])
    base, fresh = (stored(dedup.chunks(x, 64, 256, 1024), "pieces") for x in (old, new))
    stats = delta.delta_stats(base, fresh).first()
    assert 0 < stats.new_chunks < stats.total_chunks and stats.reused_chunks + stats.new_chunks == stats.total_chunks
    order, blobs = delta.create_delta(base, fresh)
    assert bytes(delta.apply_delta(base, order, blobs, new).first().content) == bytes(new.first().content)
    assert delta.delta_stats(base, base).first().new_chunks == 0 and delta.create_delta(base, base)[1].count() == 0
    wrong = delta.apply_delta(fresh.where("false"), order, blobs).first()
    assert wrong.error_class == "CorruptPackageError"
    assert delta.base_digest(old) != delta.base_digest(new) and delta.base_digest(old) == delta.base_digest(old.repartition(3))


def test_pack_and_errors(spark):
    rows = [(1, "a.txt", b"hello " * 4000), (2, "b.bin", rng.randbytes(9000)), (3, "c", b""), (4, "d.csv", b"1,2,3\n" * 9000)]
    packed = stored(pack.pack(frame(spark, rows), advanced=True), "packed")
    assert all(r.verified and r.error_class is None for r in packed.collect())
    got = {r.pkg_id: bytes(r.content) for r in pack.unpack(packed).collect()}
    assert got == {i: c for i, _, c in rows}
    assert {r.item_id: r.codec for r in packed.collect()}[2] == "store"
    assert {r.verdict for r in pack.certify(packed).collect()} == {"PASS"}
    assert {r.error_class for r in pack.unpack(packed.where("item_id = 1"), cap=10).collect()} == {"OutputLimitError"}
    with pytest.raises(Exception, match="OutputLimitError"):
        pack.unpack(packed, cap=10, strict=True).select("error_class").collect()
    bad = spark.createDataFrame([(1, b"TQZ2\0\0\0\x05notjs"), (2, b""), (3, None)], "item_id bigint, package binary")
    assert {r.error_class for r in pack.unpack(bad).collect()} == {"CorruptPackageError"}
    assert {r.h.error_class for r in bad.select(pack.header(F.col("package")).alias("h")).collect()} == {"CorruptPackageError"}
    assert {r.verdict for r in pack.certify(bad).collect()} == {"FAIL"}
    old = pack.pack_v1(frame(spark, rows), "fast")
    assert {r.pkg_id: bytes(r.content) for r in pack.unpack(old).collect()} == {i: c for i, _, c in rows}
    assert {r.verdict for r in pack.certify(old).collect()} == {"UNVERIFIED"} and {r.verdict for r in pack.certify(old, compat=True).collect()} == {"PASS"}
    assert "verdict: PASS" in pack.certificate_lines(pack.certify(packed)).first().text
    assert [r.hit_target for r in pack.pack_to_target(frame(spark, rows[:2]), 2000).orderBy("item_id").collect()] == [True, False]
    lines = pack.benchmark_lines(pack.benchmark(frame(spark, rows[:1]), ["fast"])).collect()
    assert lines[0].line.startswith("fast      ")


def test_partitions_do_not_matter(spark):
    docs = frame(spark, [(i, f"{i}.txt", (f"text {i} " * (50 * i)).encode()) for i in range(12)])
    one, many = (sorted((r.item_id, bytes(r.package)) for r in pack.pack(docs.repartition(n)).collect()) for n in (1, 6))
    assert one == many


def test_analyse(spark):
    wave = struct.pack("<30000h", *[int(12000 * math.sin(i / 40)) for i in range(30000)])
    rows = [(1, "a.txt", b"hello " * 5000), (2, "x", rng.randbytes(60000)), (3, "e", b""), (4, "a.wav", wave), (4, "b.wav", wave)]
    found = pack.analyse(frame(spark, rows)).collect()
    got = {r.item_id: r for r in found}
    assert len(found) == 5
    assert (got[2].codec, got[2].transform, got[2].verdict) == ("store", "none", "incompressible") and got[2].tests == {}
    assert got[1].verdict == "compressible" and got[1].entropy < 3 and got[1].tests.keys() == {"none", "delta8", "xor8", "bwt", "pngfilter"}
    assert (got[3].transform, got[3].codec, got[3].est_ratio, got[3].tests) == ("none", "zstd", 1.0, {})
    assert got[4].transform == "delta16le" and got[4].est_ratio < 0.5 and got[4].est_ratio == min(got[4].tests.values())


def test_race_decides_like_a_plain_minimum(spark):
    """The winner is the least ratio of all trials, the first of equals, and it is what a pack uses."""
    rows = [(k, f"{k}.{kind}", data) for k, (kind, data) in enumerate([("csv", b"a,b,c\n" + b"".join(b"%d,%d,x\n" % (i, i * 7 % 13) for i in range(9000))), ("json", b'{"k": [1, 2, 3]}' * 3000), ("exe", bytes(range(64)) * 400), ("txt", rng.randbytes(2500).hex().encode() * 3)])]
    kinds = {0: "csv", 1: "json", 2: "executable", 3: "text"}
    analysed = {r.item_id: r for r in pack.analyse(frame(spark, rows)).collect()}
    packed = {r.item_id: r for r in pack.pack(frame(spark, rows), advanced=True).collect()}
    for k, _, data in rows:
        trials = race.trials(data[: race.SELECT_SAMPLE], race.CANDIDATES[kinds[k]])
        best = min(trials, key=lambda r: r["size"] / r["tried"])
        assert (analysed[k].kind, analysed[k].transform, analysed[k].est_ratio) == (kinds[k], best["transform"], round(best["size"] / best["tried"], 4))
        assert packed[k].verified and packed[k].transform in ("none", best["transform"])


def test_opened_is_unpack_and_certify(spark):
    packed = pack.pack(frame(spark, [(1, "a.txt", b"hello " * 500), (2, "b.bin", rng.randbytes(900)), (3, "c", b"")]))
    old = pack.pack_v1(frame(spark, [(4, "d.txt", b"old")]))
    bad = packed.where("item_id = 1").select(F.lit(5).cast("bigint").alias("item_id"), F.concat("package", F.lit(b"x")).alias("package"))
    every = packed.select("item_id", "package").unionByName(old.select("item_id", "package")).unionByName(bad).unionByName(spark.createDataFrame([(6, b"junk"), (7, None), (8, bytes(packed.first().package[:-3]))], "item_id bigint, package binary"))
    every = stored(every, "packages")
    got = {r.pkg_id: r for r in pack.opened(every).collect()}
    for r in pack.unpack(every).collect():
        assert (r.content, r.size, r.sha256, r.kind, r.verified, r.error_class) == tuple(got[r.pkg_id][c] for c in ("content", "size", "sha256", "kind", "verified", "error_class"))
    for r in pack.certify(every).collect():
        assert (r.verdict, r.checks) == (got[r.pkg_id].verdict, got[r.pkg_id].checks)


def test_table_backend(spark):
    store = dedup.BlobStore(spark, dedup.TableBackend(spark, "packsmith_blobs"))
    spark.sql("DROP TABLE IF EXISTS packsmith_blobs")
    blobs = spark.createDataFrame([("aa01", b"one"), ("aa01", b"one"), ("bb02", b"two")], "sha string, data binary")
    store.put(blobs)
    store.put(blobs)
    assert store.count() == 2
    asked = spark.createDataFrame([("bb02",), ("cc03",)], "sha string")
    assert sorted((r.sha, r.found) for r in store.get(asked).collect()) == [("bb02", True), ("cc03", False)]
    assert [r.sha for r in store.contains(asked).collect()] == ["bb02"]
    spark.sql("DROP TABLE packsmith_blobs")


def test_shared_dictionary(spark):
    """One dictionary for a group of alike items helps each of them; a group with too little to learn from has none."""
    one = lambda k: f"record {k}: status=ok; host=server-{k % 7}.example.org; message=everything is fine here\n".encode() * 6
    rows = [(k, "many", one(k)) for k in range(400)] + [(1000, "few", b"x")]
    found = {r.grp: r.dictionary for r in pack.shared_dictionary(spark.createDataFrame(rows, "item_id bigint, grp string, content binary"), "grp", 4096).collect()}
    assert found["few"] is None
    dictionary, data = bytes(found["many"]), one(5000)
    packed = transforms.dict_compress(data, dictionary)
    assert transforms.dict_decompress(packed, dictionary, len(data)) == data and len(packed) < len(codecs.compress(data, "zstd"))


def test_joined_bytes(spark):
    parts = [bytes(range(256)), b"", "é中".encode(), b"\x00\xff"]
    df = spark.createDataFrame([(1, parts), (2, [])], "id int, parts array<binary>")
    got = {r.id: bytes(r.whole) for r in df.select("id", scalars.joined_bytes(F.col("parts")).alias("whole")).collect()}
    assert got == {1: b"".join(parts), 2: b""}


def test_shared_folder_is_asked_for_on_a_cluster():
    def session(master):
        none = SimpleNamespace(isDefined=lambda: False)
        return SimpleNamespace(conf={}, sparkContext=SimpleNamespace(master=master, getConf=dict, _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: none)), setCheckpointDir=lambda where: None))

    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError, match="checkpoint"):
            shared_dir(session(master))
    for master in ("local", "local[4]", "local[*]"):
        assert shared_dir(session(master))


def test_encryption(spark):
    plain = spark.createDataFrame([(i, f"secret {i}".encode() * i) for i in range(5)], "item_id bigint, package binary")
    sealed = stored(pack.encrypt(plain, "password", iterations=1000), "sealed")
    assert {r.item_id: bytes(r.package) for r in pack.decrypt(sealed, "password").collect()} == {r.item_id: bytes(r.package) for r in plain.collect()}
    assert {r.error_class for r in pack.decrypt(sealed, "other").collect()} == {"PasswordError"}
    n = F.octet_length("package")
    flipped = sealed.withColumn("package", F.concat(F.substring("package", F.lit(1), n - 1), F.unhex(F.lpad(F.hex(F.conv(F.hex(F.substring("package", n, F.lit(1))), 16, 10).cast("int").bitwiseXOR(F.lit(1))), 2, "0"))))
    assert {r.error_class for r in pack.decrypt(flipped, "password").collect()} == {"PasswordError"}
    junk = spark.createDataFrame([(1, b"junk"), (2, None), (3, b"TQZE\0\0\0\x02{}abc")], "item_id bigint, package binary")
    assert {r.error_class for r in pack.decrypt(junk, "password").collect()} == {"CorruptPackageError"}
    assert len({bytes(r.package) for r in sealed.collect()}) == 5
    with pytest.raises(ValueError):
        pack.encrypt(plain, "")


def test_archives(spark):
    def archive(members, level):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED, compresslevel=level) as z:
            for name, data in members:
                z.writestr(name, data)
        return out.getvalue()

    members = [("a.txt", b"hello " * 3000), ("dir/b.bin", rng.randbytes(500)), ("empty", b"")]
    docs = frame(spark, [(1, "a.zip", archive(members, 1)), (2, "b.zip", b"no archive")])
    rows = archives.zip_members(docs).orderBy("item_id", "seq").collect()
    assert [(r.name, bytes(r.content)) for r in rows if r.item_id == 1] == members and rows[-1].error_class == "CorruptPackageError"
    better = {r.item_id: r for r in archives.recompress_zips(docs).collect()}
    assert better[1].same and better[1].new <= better[1].orig and better[2].error_class == "CorruptPackageError"
    other = frame(spark, [(1, "a.zip", archive(members[:2] + [("empty", b"!")], 1))])
    assert archives.compare_archives(archives.zip_members(docs.where("item_id = 1")), archives.zip_members(other)).first().same is False


def test_files_and_limits(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for k in range(4):
        (tmp_path / "in" / f"{k}.txt").write_bytes(b"x" * (10 * k + 5))
    (tmp_path / "skip.bin").write_bytes(b"x")
    found = items.file_items(spark, str(tmp_path), "*.txt")
    assert found.count() == 4 and items.file_items(spark, str(tmp_path), "*.txt", largest=15).count() == 2
    ok, rejected = items.admitted(found, 15)
    assert ok.count() == 2 and {r.error_class for r in rejected.collect()} == {"OutputLimitError"}


def test_stream(spark, tmp_path):
    for k, text in enumerate(["one", "two", "one"]):
        (tmp_path / f"{k}.txt").write_text(text)
    stream = streaming.new_content(streaming.stream_files(spark, str(tmp_path)))
    query = stream.select("sha256").writeStream.format("memory").queryName("fresh").outputMode("append").start()
    try:
        query.processAllAvailable()
        assert spark.table("fresh").count() == 2
    finally:
        query.stop()
    volume = streaming.windowed_volume(streaming.stream_files(spark, str(tmp_path))).writeStream.format("memory").queryName("volume").outputMode("complete").start()
    try:
        volume.processAllAvailable()
        assert spark.table("volume").agg(F.sum("bytes")).first()[0] == 9
    finally:
        volume.stop()


def test_cancel_and_progress(spark):
    token = progress.CancelToken(spark)
    with token.running("count"):
        assert spark.range(10).count() == 10
    token.cancel()
    with pytest.raises(errors.CancelledError), token.running("again"):
        pass
    said = []
    show = progress.text_bar(said.append)
    for done in range(0, 101):
        show(done, 100, "pack")
    assert len(said) == 21 and said[-1] == "pack: 100%"
    progress.progress(spark, lambda *x: said.append(str(x)), "idle")
