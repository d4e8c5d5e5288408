import pytest

from sparklake import errors
from sparklake.config import MIB, Secret, Settings
from sparklake.schema import EVENT_SCHEMA, describe, guard


def load(**sections):
    return Settings.load(environ={}, **sections)


def test_defaults_hold():
    s = load()
    assert (s.ingestion.max_batch_rows, s.buffer.compression_level, s.compaction.min_input_files) == (20_000, 3, 8)
    assert s.runtime.soft_memory_bytes < s.runtime.hard_memory_bytes <= s.runtime.memory_ceiling_bytes


@pytest.mark.parametrize(
    "section",
    [
        {"runtime": {"soft_memory_bytes": 480 * MIB}},
        {"runtime": {"memory_ceiling_bytes": 463 * MIB, "hard_memory_bytes": 460 * MIB}},
        {"compaction": {"target_file_bytes": 8 * MIB}},
        {"catalog": {"commit_backoff_base_seconds": 6.0}},
        {"ingestion": {"max_reject_ratio": 1.1}},
        {"ingestion": {"max_batch_rows": 0}},
        {"buffer": {"max_rows": 99_999}},
        {"buffer": {"max_age_seconds": 0}},
        {"catalog": {"table_name": "1x"}},
        {"runtime": {"env": "prod"}},
        {"nonsense": {"a": 1}},
        {"buffer": {"nonsense": 1}},
        {"buffer": {"max_rows": "many"}},
    ],
)
def test_refused(section):
    with pytest.raises(errors.ConfigurationError) as e:
        load(**section)
    assert str(e.value).startswith("[1001] ") and not e.value.retryable


def test_prod_refuses_file_uri_in_tmp():
    with pytest.raises(errors.ConfigurationError):
        load(runtime={"env": "prod"}, ingestion={"dlq_dir": "/srv/d"}, query={"temp_dir": "/srv/t"}, catalog={"warehouse": "file:///tmp/w"})


def test_environment_and_file(tmp_path):
    (tmp_path / "env").write_text("# c\nSPARKLAKE_BUFFER__MAX_AGE_SECONDS=5\nSPARKLAKE_QUERY__THREADS=3\n")
    s = Settings.load(env_file=str(tmp_path / "env"), environ={"SPARKLAKE_QUERY__THREADS": "4", "OTHER": "x"}, buffer={"max_rows": 200_000})
    assert (s.buffer.max_age_seconds, s.query.threads, s.buffer.max_rows) == (5.0, 4, 200_000)


def test_secrets_are_hidden():
    s = load(storage={"s3_secret_key": "hush"})
    assert "hush" not in repr(s) and "hush" not in f"{s.storage.s3_secret_key}" and Secret("hush").reveal() == "hush"


def test_error_codes_and_context():
    e = errors.CatalogCommitError("no", pending_files=["a"])
    assert (e.code, e.retryable, e.context["pending_files"], str(e)) == (4003, True, ["a"], "[4003] no")
    with pytest.raises(TypeError):
        e.context["x"] = 1


def test_schema_guard():
    guard(describe(EVENT_SCHEMA))
    bad = describe(EVENT_SCHEMA)
    bad[0]["type"], bad[1]["name"], bad[2]["required"] = "int", "uid", False
    with pytest.raises(errors.SchemaEvolutionError) as e:
        guard(bad[:4])
    assert len(e.value.context["diff"]) == 4
