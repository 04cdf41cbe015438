import io
import json
import tarfile
from dataclasses import replace
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from millrace import session
from millrace.catalog import reading
from millrace.catalog.corpus import stream_clean
from millrace.config import CorpusConfig, SourceSpec
from millrace.functions.cleaning import web_clean
from millrace.operators.tokenizing import encode_with
from millrace.plans.prepare import prepare_corpus
from millrace.sources import tar_shards
from millrace.sources.stages import StageStore
from millrace.sources.tar_shards import (
    ShardsWritten,
    TarShardReader,
    TarShardWriter,
    _member,
    bad_samples,
    list_prefixes,
    list_shards,
    open_fs,
    read_shards,
    verify_shards,
    write_shards,
)
from millrace.sources.text import read_jsonl, read_source, write_jsonl
from millrace.streaming.clean_stream import (
    cleaned_stream,
    read_numbered,
    read_progress,
    start_numbered_sink,
)


@pytest.fixture(scope="module")
def sharded(spark):
    """235 fragments in shards of 20, every fifth without a mask."""
    return spark.range(235).selectExpr(
        "cast(id div 20 as int) as shard_idx",
        "cast(id % 20 as int) as shard_pos",
        "format_string('%05d_%05d', id div 20, id % 20) as sample_key",
        "concat('wéb_', id div 3) as original_id",
        "'wéb' as domain",
        "cast(id % 3 as int) as fragment_idx",
        "array(cast(id as int), 5) as input_ids",
        "if(id % 5 = 0, null, array(1, 0)) as attention_mask",
    )


def as_rows(df):
    return {
        (r.sample_key, r.original_id, r.domain, r.fragment_idx, tuple(r.ids), tuple(r.attention_mask or ()))
        for r in df.collect()
    }


def test_shards_round_trip(spark, sharded, tmp_path):
    write_shards(sharded, str(tmp_path), "train")
    back = read_shards(spark, str(tmp_path), "train")
    assert as_rows(back.withColumnRenamed("text", "ids")) == as_rows(
        sharded.withColumnRenamed("input_ids", "ids")
    )
    stored = {s.name: tmp_path / s.file for s in list_shards(str(tmp_path), "train")}
    assert list(stored) == [f"train-{i:05d}.tar" for i in range(12)]
    with tarfile.open(stored["train-00011.tar"]) as tar:
        members = tar.getnames()
        assert members[:2] == ["00011_00000.json", "00011_00000.input.json"]
        assert json.load(tar.extractfile("00011_00001.input.json")) == [221, 5]
        assert json.load(tar.extractfile("00011_00001.json")) == {
            "original_id": "wéb_73", "domain": "wéb", "fragment_idx": 2,
        }


def test_writing_again_replaces_one_prefix_only(spark, sharded, tmp_path):
    write_shards(sharded, str(tmp_path), "train")
    write_shards(sharded.filter("shard_idx = 0"), str(tmp_path), "val")
    write_shards(sharded.filter("shard_idx < 2"), str(tmp_path), "train")
    shards = [s for prefix in ("train", "val") for s in list_shards(str(tmp_path), prefix)]
    assert [s.name for s in shards] == ["train-00000.tar", "train-00001.tar", "val-00000.tar"]
    # Nothing else is left but offsets and a manifest for each prefix.
    assert {p.name for p in tmp_path.iterdir() if p.suffix == ".tar"} == {s.file for s in shards}
    assert len([p for p in tmp_path.iterdir() if p.suffix in (".index", ".manifest")]) == 5
    checked = verify_shards(spark, str(tmp_path)).collect()
    assert {(r.shard, r.ok, r.members) for r in checked} == {
        ("train-00000.tar", True, 5), ("val-00000.tar", True, 5),
    }


def test_gaps_in_a_shard_are_refused(sharded, tmp_path):
    with pytest.raises(Exception, match="expected position"):
        write_shards(sharded.filter("shard_pos <> 3"), str(tmp_path), "train")
    assert not list(tmp_path.iterdir())


def _batch(sharded, where):
    columns = ["shard_idx", "shard_pos", "sample_key", "'{}' as about", "'[1]' as input", "cast(null as string) as mask"]
    return sharded.filter(where).orderBy("shard_idx", "shard_pos").selectExpr(*columns).toArrow().to_batches()


def test_attempts_that_died_are_never_seen(sharded, tmp_path):
    """A task is killed in the middle of a shard and runs again; another one comes too late."""
    path = str(tmp_path)
    writer = TarShardWriter(path, "train", overwrite=True)
    rows = _batch(sharded, "shard_idx < 2")

    def killed():
        yield rows[0].slice(0, 25)
        raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        writer.write(killed())
    good = writer.write(iter(rows))
    files = {s.file for s in good.shards}
    assert len(list(tmp_path.glob("train-*.tar"))) == 4
    with pytest.raises(FileNotFoundError):
        list_shards(path, "train")
    writer.commit([good, None])
    assert {p.name for p in tmp_path.glob("train-*.tar")} == files
    writer.write(iter(rows))
    assert {s.file for s in list_shards(path, "train")} == files
    keys = [r["sample_key"] for p in TarShardReader(path, "train").partitions() for r in TarShardReader(path, "train")._rows(p)]
    assert keys == [f"{i:05d}_{k:05d}" for i in range(2) for k in range(20)]


def test_attempts_named_by_digits_are_no_other_prefix(spark, sharded, tmp_path, monkeypatch):
    """their shards were checked twice, under two names."""
    path = str(tmp_path)
    writer = TarShardWriter(path, "train", overwrite=True)
    monkeypatch.setattr(tar_shards.uuid, "uuid4", lambda: SimpleNamespace(hex="123456789012" * 2))
    writer.commit([writer.write(iter(_batch(sharded, "shard_idx < 2")))])
    monkeypatch.undo()
    (tmp_path / "other-00000.tar").write_bytes(b"")
    assert list_prefixes(path) == ["other", "train"]
    checked = verify_shards(spark, path, every_n=1).collect()
    assert sorted(r.shard for r in checked) == ["other-00000.tar", "train-00000.tar", "train-00001.tar"]


def test_a_commit_that_died_changes_nothing(sharded, tmp_path):
    path = str(tmp_path)
    first = TarShardWriter(path, "train", overwrite=True)
    first.commit([first.write(iter(_batch(sharded, "shard_idx = 0")))])
    before = list_shards(path, "train")
    whole = (tmp_path / "_train-00000001.manifest").read_bytes()
    second = TarShardWriter(path, "train", overwrite=True)
    late = second.write(iter(_batch(sharded, "shard_idx = 1")))
    for torn in (whole[:-3], whole.splitlines()[0], b""):
        (tmp_path / "_train-00000002.manifest").write_bytes(torn)
        assert list_shards(path, "train") == before
    second.commit([late])
    assert [s.name for s in list_shards(path, "train")] == ["train-00001.tar"]
    assert [p.name for p in tmp_path.glob("*.manifest")] == ["_train-00000003.manifest"]


def test_two_tasks_with_one_shard_are_refused(sharded, tmp_path):
    writer = TarShardWriter(str(tmp_path), "train", overwrite=True)
    rows = _batch(sharded, "shard_idx = 0")
    twice = [writer.write(iter(rows)), writer.write(iter(rows))]
    with pytest.raises(ValueError, match="several tasks"):
        writer.commit(twice)
    assert not list(tmp_path.iterdir()) and isinstance(twice[0], ShardsWritten)


def test_one_shard_is_read_by_several_tasks(spark, tmp_path):
    whole = spark.range(3000).selectExpr(
        "0 as shard_idx", "cast(id as int) as shard_pos", "format_string('00000_%05d', id) as sample_key",
        "concat('d', id) as original_id", "'x' as domain", "0 as fragment_idx",
        "sequence(0, cast(id % 50 as int)) as input_ids", "array(1) as attention_mask",
    )
    path = str(tmp_path)
    write_shards(whole, path, "train")
    (shard,) = list_shards(path, "train")
    assert shard.size == (tmp_path / shard.file).stat().st_size or shard.size + 10240 > (tmp_path / shard.file).stat().st_size
    rows = as_rows(whole.withColumnRenamed("input_ids", "ids"))
    for split in (100_000, 1_000_000, 1 << 30):
        back = read_shards(spark, path, "train", split_bytes=split)
        assert back.rdd.getNumPartitions() == -(-shard.size // split)
        got = back.collect()
        assert len(got) == 3000 and all(r.error is None for r in got)
        assert as_rows(back.withColumnRenamed("text", "ids")) == rows
    busy = read_shards(spark, path, "train", split_bytes=1_000_000).select(F.spark_partition_id()).distinct().count()
    assert busy == -(-shard.size // 1_000_000)
    (tmp_path / f"{shard.file}.index").unlink()
    assert as_rows(read_shards(spark, path, "train", split_bytes=1_000_000).withColumnRenamed("text", "ids")) == rows
    # Cut off in the middle: what is whole is read, and every task that misses something says so.
    (tmp_path / shard.file).write_bytes((tmp_path / shard.file).read_bytes()[: shard.size // 2])
    bad = read_shards(spark, path, "train", split_bytes=1_000_000)
    assert 0 < bad.filter("error IS NULL").count() < 3000 and bad.filter("error IS NOT NULL").count() >= 1


def test_many_small_shards_share_tasks(spark, sharded, tmp_path):
    many = spark.range(600).selectExpr(
        "cast(id as int) as shard_idx", "0 as shard_pos", "format_string('%05d_00000', id) as sample_key",
        "concat('d', id) as original_id", "'x' as domain", "0 as fragment_idx", "array(1, 2) as input_ids", "array(1, 1) as attention_mask",
    )
    path = str(tmp_path)
    write_shards(many, path, "train", tasks=2)
    back = read_shards(spark, path, "train")
    assert back.rdd.getNumPartitions() < 300
    assert as_rows(back.withColumnRenamed("text", "ids")) == as_rows(many.withColumnRenamed("input_ids", "ids"))


@pytest.mark.parametrize("name", ["a.json", "é.json", "k" * 96 + ".x", "d/" + "k" * 98 + "/x.json"])
@pytest.mark.parametrize("size", [0, 511, 512, 1000])
def test_members_are_written_as_tarfile_does(name, size):
    want, info = io.BytesIO(), tarfile.TarInfo(name)
    info.size = size
    with tarfile.open(fileobj=want, mode="w|", format=tarfile.USTAR_FORMAT) as tar:
        tar.addfile(info, io.BytesIO(b"x" * size))
        end = tar.offset
    assert _member(name, b"x" * size) == want.getvalue()[:end]


def test_any_cut_or_broken_byte_reads_as_by_tarfile(tmp_path):
    content = [(f"{k}.{e}", b"%d" % k * (k * 300)) for k in range(4) for e in ("json", "input.json")]
    _tar(tmp_path / "whole.tar", content)
    good = (tmp_path / "whole.tar").read_bytes()
    end = len(good.rstrip(b"\0"))
    for at in range(0, end + 600, 97):
        for bad in (good[:at], good[:at] + b"\xff" + good[at + 1 :]):
            (tmp_path / "train-00000.tar").write_bytes(bad)
            reader = TarShardReader(str(tmp_path), "train")
            (part,) = reader.partitions()
            fs, root = open_fs(str(tmp_path))
            assert [*reader._rows(part)] == [*reader._other_samples(fs, root, part.pieces[0], 0, None, 0)]


def test_missing_shards_are_an_error(spark, tmp_path):
    with pytest.raises(Exception, match="no shards match"):
        read_shards(spark, str(tmp_path), "train").count()


def _tar(path, members):
    with tarfile.open(path, "w") as tar:
        for name, content in members:
            info = tarfile.TarInfo(name)
            info.size = len(content)
            tar.addfile(info, io.BytesIO(content))


def test_tolerant_reading(spark, sharded, tmp_path):
    write_shards(sharded.filter("shard_idx < 2"), str(tmp_path), "train")
    about = b'{"original_id": "a", "domain": "d", "fragment_idx": 0}'
    _tar(
        tmp_path / "train-00002.tar",
        [
            ("00002_00000.json", about), ("00002_00000.input.json", b"[1, 2]"),
            ("00002_00001.json", b"{oops"), ("00002_00001.input.json", b"[1]"),
            ("00002_00002.json", about), ("00002_00002.input.json", b'[1, "x"]'),
            ("00002_00003.json", about),
            ("00002_00004.json", about), ("00002_00004.input.json", b"[1]"),
            ("00002_00004.mask.json", b"nope"), ("00002_00004.txt", b"ignored"),
        ],
    )
    second = tmp_path / next(s.file for s in list_shards(str(tmp_path), "train") if s.number == 1)
    second.write_bytes(second.read_bytes()[:6000])
    (tmp_path / "train-00010.tar").write_bytes(b"this is not a tar file" * 100)
    path = str(tmp_path)
    good = read_shards(spark, path, "train", "DROPMALFORMED")
    keys = {r.sample_key for r in good.collect()}
    assert {k for k in keys if k.startswith("00002")} == {"00002_00000"}
    assert len([k for k in keys if k.startswith("00000")]) == 20
    bad = {(r.shard, r.sample_key) for r in bad_samples(spark, path, "train").collect()}
    assert {("train-00002.tar", f"00002_0000{i}") for i in (1, 2, 3, 4)} <= bad
    assert ("train-00010.tar", None) in bad
    with pytest.raises(Exception, match="bad sample"):
        read_shards(spark, path, "train", "FAILFAST").collect()
    with pytest.raises(ValueError):
        read_shards(spark, path, "train", "LENIENT")
    verdict = {r.shard: r.ok for r in verify_shards(spark, path, "train").collect()}
    assert verdict == {"train-00000.tar": True, "train-00010.tar": False}
    every = verify_shards(spark, path, "train", every_n=1, max_members=1000).collect()
    assert {r.shard: r.ok for r in every}["train-00002.tar"]


def _damages(good, at):
    """An archive whose sixth member begins at ``at``, damaged from there on: only a check of the
    whole file can tell."""
    return {
        "header": good[: at + 3] + b"\xff" + good[at + 4 :],
        "zeroed": good[:at] + bytes(512) + good[at + 512 :],
        "cut between members": good[:at],
        "cut in a header": good[: at + 100],
        "cut in a content": good[: at + 600],
        "last cut": good[: len(good.rstrip(b"\0")) - 1],
    }


@pytest.mark.parametrize("form", [tarfile.USTAR_FORMAT, tarfile.PAX_FORMAT, tarfile.GNU_FORMAT])
def test_all_shards_are_verified_to_their_end(spark, tmp_path, form):
    """damage past the first members, and in shards that are not the tenth."""
    whole = io.BytesIO()
    with tarfile.open(fileobj=whole, mode="w", format=form) as tar:
        for i in range(8):
            info = tarfile.TarInfo("k" * (120 if i == 2 and form != tarfile.USTAR_FORMAT else 5) + f"{i}.json")
            info.size = 700
            tar.addfile(info, io.BytesIO(b"x" * 700))
    with tarfile.open(fileobj=io.BytesIO(whole.getvalue())) as tar:
        damages = _damages(whole.getvalue(), tar.getmembers()[5].offset)
    (tmp_path / "train-00000.tar").write_bytes(whole.getvalue())
    for number, damaged in enumerate(damages.values(), 1):
        (tmp_path / f"train-{number:05d}.tar").write_bytes(damaged)
    found = {r.shard: r for r in verify_shards(spark, str(tmp_path), every_n=1, max_members=None).collect()}
    assert len(found) == 1 + len(damages)
    assert found["train-00000.tar"].ok and found["train-00000.tar"].members == 8
    for number, kind in enumerate(damages, 1):
        row = found[f"train-{number:05d}.tar"]
        assert not row.ok and row.error.startswith("ReadError") and 5 <= row.members <= 8, kind


def test_written_shards_are_verified_whole(spark, sharded, tmp_path):
    write_shards(sharded, str(tmp_path), "train")
    found = verify_shards(spark, str(tmp_path), every_n=1, max_members=None).collect()
    members = {f"train-{i:05d}.tar": 3 * n - -(-n // 5) for i, n in enumerate([20] * 11 + [15])}
    assert {r.shard: (r.ok, r.error, r.members) for r in found} == {k: (True, None, n) for k, n in members.items()}


def test_broken_shards_are_found_past_their_beginning(spark, sharded, tmp_path, monkeypatch):
    """the damage of one shard is in its last sample."""
    write_shards(sharded.filter("shard_idx < 3"), str(tmp_path), "train")
    last = tmp_path / next(s.file for s in list_shards(str(tmp_path), "train") if s.number == 2)
    content = last.read_bytes()
    at = content.index(b"00002_00019.input.json")
    last.write_bytes(content[:at] + b"#" + content[at + 1 :])
    monkeypatch.setattr(reading, "_damaged", lambda spark, sf_dir: str(tmp_path))
    found = {r.shard: (r.ok, r.error) for r in reading.shard_verify_broken(spark, "").collect()}
    assert found == {
        "train-00000.tar": (True, None), "train-00001.tar": (True, None), "train-00002.tar": (False, "ReadError"),
    }


def test_shards_are_verified_in_parts_and_nothing_is_left(spark, tmp_path, monkeypatch):
    """at no time are more shards on disk than a part has; texts, tokens and shards go."""
    words = "concat_ws(' ', transform(sequence(1, 200 + cast(id * 37 % 300 as int)), i -> concat('w', i * id % 91)))"
    spark.range(150).selectExpr("id as doc_id", f"{words} as text").write.parquet(str(tmp_path / "documents.parquet"))
    talks = spark.range(40).selectExpr("id as conv_id", "1 as turn", f"if(id = 7, null, {words}) as text")
    talks.write.parquet(str(tmp_path / "conversations.parquet"))
    scratch = tmp_path / "scratch"
    monkeypatch.setattr(session, "scratch_root", lambda spark: str(scratch))
    monkeypatch.setattr(reading, "SHARD_SIZE", 10)
    monkeypatch.setattr(reading, "WAVE_SHARDS", 3, raising=False)
    there, verify = [], reading.verify_shards

    def counted(*args, **options):
        there.append(len(list(scratch.rglob("*.tar"))))
        return verify(*args, **options)

    monkeypatch.setattr(reading, "verify_shards", counted)
    found = reading.shard_verify(spark, str(tmp_path))
    assert {p.name.rpartition("-")[0] for p in (scratch / "millrace").iterdir()} - {"split-bins", "split-edge", "split-cuts"} == {"verdicts"}
    rows = found.collect()
    want = {r.split: (r.n_shards, r.n_fragments) for r in reading.shard_summary(spark, str(tmp_path)).collect()}
    got = {k: [r for r in rows if r.shard.startswith(f"{k}-")] for k in want}
    assert {k: (len(v), sum(r.members for r in v) / 3) for k, v in got.items()} == want
    assert len({r.shard for r in rows}) == len(rows) and all(r.ok for r in rows)
    assert len(there) > 8 and max(there) <= max(3, -(-want["train"][0] // 8)) and sum(there) == len(rows)


def test_a_byte_that_is_no_text_fails_its_sample(spark, tmp_path):
    _tar(
        tmp_path / "train-00000.tar",
        [
            ("00000_00000.json", b'{"original_id": "\xff", "domain": "d", "fragment_idx": 0}'),
            ("00000_00000.input.json", b"[1]"),
            ("00000_00001.json", b'{"original_id": "b", "domain": "d", "fragment_idx": 0}'),
            ("00000_00001.input.json", b"[2]"),
        ],
    )
    rows = {r.sample_key: r for r in read_shards(spark, str(tmp_path), "train").collect()}
    assert "UnicodeDecodeError" in rows["00000_00000"].error and rows["00000_00001"].error is None


def test_jsonl_round_trip(spark, tmp_path):
    rows = [("a_0", "a", "é \"q\" \\ \n x", 0), ("a_1", "a", "😀", 1)]
    df = spark.createDataFrame(rows, "id string, domain string, text string, pos bigint")
    write_jsonl(df, str(tmp_path / "out"))
    assert {tuple(r) for r in read_jsonl(spark, str(tmp_path / "out")).collect()} == set(rows)


def test_stage_is_built_once_and_counted(spark, tmp_path):
    store = StageStore(spark, str(tmp_path), "f")
    calls = []

    def build():
        calls.append(1)
        return spark.range(10).selectExpr("id", "if(id < 7, 'train', 'validation') as split")

    for _ in range(2):
        assert store.get("s", build, ["split"]).count() == 10
    assert len(calls) == 1
    assert store.length("s") == 10 and store.length("s", "validation") == 3
    with pytest.raises(ValueError):
        store.length("t")
    # An unfinished stage is built again.
    (tmp_path / "f" / "s" / "_SUCCESS").unlink()
    store.get("s", build, ["split"])
    assert len(calls) == 2


@pytest.fixture(scope="module")
def config(tmp_path_factory, sf_dir):
    return CorpusConfig(
        sources=(
            SourceSpec("web", f"{sf_dir}/documents.parquet", order=("doc_id",), label="Web"),
            SourceSpec(
                "math", f"{sf_dir}/conversations.parquet", cleaner="math", order=("conv_id", "turn")
            ),
        ),
        base_path=str(tmp_path_factory.mktemp("corpus")),
        max_examples=200,
        ratios=(0.7,),
        window=64,
        stride=8,
        shard_size=50,
        batch_size=16,
        shuffle_buffer=40,
        attribution={"source": "documents"},
    )


def test_whole_preparation(spark, config, tmp_path):
    corpus = prepare_corpus(spark, config, "2024-01-01")
    clean = corpus.clean.collect()
    assert len({r.id for r in clean}) == len(clean) <= 200
    assert sum(r.domain == "web" for r in clean) == 140
    assert corpus.attribution.first().processed_examples == len(clean)
    assert {r.id for r in corpus.split.collect()} == {r.id for r in clean}
    assert corpus.shuffled().count() == len(clean)
    assert sum(r.n for r in corpus.domain_stats().collect()) == len(clean)

    n = corpus.length("train")
    batches = corpus.train_batches(epoch=1).collect()
    assert len(batches) == n // 16 * 16
    assert len({r.sample_key for r in batches}) == len(batches)
    assert {sum(r.batch_id == b for r in batches) for b in {r.batch_id for r in batches}} == {16}
    order = [sorted(batches, key=lambda r: r.pos), sorted(corpus.train_batches(2).collect(), key=lambda r: r.pos)]
    assert [r.sample_key for r in order[0]] != [r.sample_key for r in order[1]]
    val = corpus.validation_batches().collect()
    assert len(val) == corpus.length("validation")
    assert sorted(r.pos for r in val) == list(range(len(val)))

    report = corpus.export_tar(str(tmp_path)).collect()
    assert report and all(r.ok for r in report)
    assert read_shards(spark, str(tmp_path), "train").count() == n
    # A second call reads what the first has stored.
    again = prepare_corpus(spark, config, "later")
    assert again.attribution.first().processing_date == "2024-01-01"


def test_a_changed_source_is_prepared_again(spark, config, tmp_path):
    from shutil import copytree

    source = tmp_path / "docs"
    rows = spark.range(60).selectExpr("id as doc_id", "repeat(concat('w', id, ' '), 12) as text")
    rows.repartition(2).write.parquet(str(source))
    own = replace(
        config, base_path=str(tmp_path / "out"), ratios=(), max_examples=1000,
        sources=(SourceSpec("web", str(source), order=("doc_id",)),),
    )
    first = prepare_corpus(spark, own, "one")
    assert first.attribution.first().processed_examples == 60
    assert prepare_corpus(spark, own, "two").attribution.first().processing_date == "one"
    more = spark.range(60, 90).selectExpr("id as doc_id", "repeat(concat('w', id, ' '), 12) as text")
    more.write.mode("append").parquet(str(source))
    again = prepare_corpus(spark, own, "three")
    assert again.store.root != first.store.root
    assert (again.attribution.first().processed_examples, again.attribution.first().processing_date) == (90, "three")
    copytree(source, tmp_path / "copy")  # files of other names and times are another input
    moved = replace(own, sources=(SourceSpec("web", str(tmp_path / "copy"), order=("doc_id",)),))
    assert prepare_corpus(spark, moved, "four").store.root != again.store.root


def test_supplied_tokenizer_needs_a_name(spark, config):
    class Ones:
        def encode(self, texts):
            return [[1] * len(t.split()) for t in texts]

    with pytest.raises(ValueError, match="tokenizer"):
        prepare_corpus(spark, config, "d", encode=lambda df: encode_with(df, Ones))
    named = replace(config, tokenizer="ones")
    assert named.fingerprint() != config.fingerprint()
    corpus = prepare_corpus(spark, named, "d", encode=lambda df: encode_with(df, Ones))
    ids = {t for r in corpus.fragments.limit(20).collect() for t in r.input_ids}
    assert ids <= {1, named.pad_id}


def test_a_lost_manifest_is_written_again(spark, tmp_path):
    store = StageStore(spark, str(tmp_path), "f")
    store.get("s", lambda: spark.range(7))
    for f in sorted((tmp_path / "f" / "manifest" / "part=s").iterdir()):
        f.unlink()
    store.get("s", lambda: pytest.fail("built twice"))
    assert store.length("s") == 7


def test_configuration_is_checked(config):
    for change in ({"ratios": ()}, {"stride": 64}, {"val_ratio": 0.0}, {"pad_id": 3}):
        with pytest.raises(ValueError):
            replace(config, **change)


def test_source_without_its_key(spark, sf_dir):
    with pytest.raises(ValueError, match="sort key"):
        read_source(spark, SourceSpec("web", f"{sf_dir}/documents.parquet", order=("nope",)))


def test_json_source_with_missing_text(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"ord": 1, "text": "x", "extra": 3}\n{"ord": 2}\n')
    source = read_source(spark, SourceSpec("web", str(tmp_path), format="json"))
    assert {tuple(r) for r in source.rows.collect()} == {(1, "x"), (2, None)}


def test_json_keys_of_other_types_and_unreadable_ones(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"ord": "k2", "text": "x"}\n{"ord": "k1", "text": "y"}\n')
    spec = SourceSpec("web", str(tmp_path), format="json", key_types=("string",))
    rows = read_source(spark, spec).rows.orderBy("ord").collect()
    assert [tuple(r) for r in rows] == [("k1", "y"), ("k2", "x")]
    with pytest.raises(Exception, match="does not fit its schema"):
        read_source(spark, SourceSpec("web", str(tmp_path), format="json")).rows.collect()


def test_source_without_its_text(spark, sf_dir):
    spec = SourceSpec("web", f"{sf_dir}/documents.parquet", order=("doc_id",), text="content")
    with pytest.raises(ValueError, match="no text column"):
        read_source(spark, spec)


def _write(folder, name, start, n):
    lines = [
        json.dumps({"ord": start + i, "text": " ".join(["w"] * (12 if i % 2 else 3))}) for i in range(n)
    ]
    (folder / name).write_text("\n".join(lines))


def _run(spark, source, out, quota):
    stream = (
        spark.readStream.schema("ord bigint, text string")
        .option("maxFilesPerTrigger", 1)
        .json(str(source))
    )
    query = start_numbered_sink(stream, web_clean, "web", ["ord"], str(out), quota)
    query.awaitTermination()
    return query


@pytest.mark.parametrize("quota", [None, 12])
def test_stream_numbers_run_on_over_batches(spark, tmp_path, quota):
    source, out = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    for b in range(3):
        _write(source, f"f{b}.json", 100 * b, 10)
    _run(spark, source, out, quota)
    want = 15 if quota is None else 12
    progress = sorted(tuple(r) for r in read_progress(spark, str(out)).collect())
    assert progress == [(0, 10, 5, 5), (1, 10, 5, 5), (2, 10, 5, want - 10)]
    assert not list((out / "work").iterdir())
    rows = read_numbered(spark, str(out)).collect()
    assert sorted(r.idx for r in rows) == list(range(want))
    assert {r.id for r in rows} == {f"web_{i}" for i in range(want)}
    # New files continue the count.
    _write(source, "f3.json", 900, 10)
    _run(spark, source, out, quota)
    rows = read_numbered(spark, str(out)).collect()
    assert sorted(r.idx for r in rows) == list(range(20 if quota is None else 12))
    last = read_progress(spark, str(out)).filter("batch = 3").first()
    assert tuple(last) == ((3, 10, 5, 5) if quota is None else (3, 0, 0, 0))


def test_documents_stored_as_many_files_are_streamed(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = {tuple(r) for r in stream_clean(spark, str(tmp_path)).collect()}
    assert got and got == {tuple(r) for r in stream_clean(spark, sf_dir).collect()}


def test_stream_with_repeated_keys_keeps_each_row_once(spark, tmp_path):
    source, out = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    lines = [json.dumps({"ord": i % 3, "text": f"t{i} " * 12}) for i in range(30)]
    (source / "a.json").write_text("\n".join(lines))
    _run(spark, source, out, None)
    rows = read_numbered(spark, str(out)).collect()
    assert len({r.text for r in rows}) == 30 and sorted(r.idx for r in rows) == list(range(30))


def test_replayed_batch_gives_the_same_ids(spark, tmp_path):
    source, out = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    for b in range(2):
        _write(source, f"f{b}.json", 100 * b, 10)
    _run(spark, source, out, None)
    before = {tuple(r) for r in read_numbered(spark, str(out)).collect()}
    # Forget that the last batch was committed: it runs again.
    (out / "log" / "commits" / "1").unlink()
    crc = out / "log" / "commits" / ".1.crc"
    if crc.exists():
        crc.unlink()
    _run(spark, source, out, None)
    assert {tuple(r) for r in read_numbered(spark, str(out)).collect()} == before


def test_observed_counts_do_not_change_rows(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    assert cleaned_stream(df, web_clean).count() == (
        df.filter(F.size(F.split(web_clean(F.col("text")), " ")) > 10).count()
    )
