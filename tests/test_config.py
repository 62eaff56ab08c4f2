import pytest

from slicewise.config import ConfigError, Policy, Profile, Resolution, discover_masks_file, load_masks_file, load_policy, load_profile, resolve_masks

POLICY = """
version: 1
databases:
  harbour:
    columns:
      captains.title: {expr: "'someone'", tags: [person]}
      captains.berth: {expr: "0", tags: [person, place]}
      cargo.worth: {expr: "1", tags: [money]}
      ports.gate_code: {expr: "'-'", tags: [secret]}
    policies:
      people: {include_tags: [person]}
      ledger: {include_tags: [money]}
"""


@pytest.fixture
def folder(tmp_path):
    (tmp_path / ".git").mkdir()
    (tmp_path / "data-masking-policy.yml").write_text(POLICY)
    return tmp_path


def profile(folder, text):
    path = folder / "p.yaml"
    path.write_text(text)
    return load_profile(path)


def test_union_of_policies(folder):
    p = profile(folder, "database_id: harbour\nmasks_file: data-masking-policy.yml\nextract: {mask_policies: [people, ledger], masks: [a.b=1]}\n")
    assert resolve_masks(p) == ["captains.berth=0", "captains.title='someone'", "cargo.worth=1", "a.b=1"]
    assert resolve_masks(p, disabled=True) == []
    assert resolve_masks(p, flag_policies=["ledger"]) == ["cargo.worth=1", "a.b=1"]


def test_inline_and_discovered(folder):
    p = profile(folder, "database_id: harbour\nmasks: {extra: [t.c=2]}\nextract: {mask_policies: [people, extra]}\n")
    assert resolve_masks(p) == ["captains.berth=0", "captains.title='someone'", "t.c=2"]
    only_inline = profile(folder, "database_id: harbour\nmasks: {extra: [t.c=2]}\nextract: {mask_policies: [extra]}\n")
    assert resolve_masks(only_inline) == ["t.c=2"]
    every = profile(folder, "database_id: harbour\n")
    assert len(resolve_masks(every)) == 4
    with pytest.raises(ConfigError, match="'nothing' is a policy neither"):
        resolve_masks(profile(folder, "database_id: harbour\nextract: {mask_policies: [nothing]}\n"))


def test_missing_database(folder):
    with pytest.warns(UserWarning):
        assert resolve_masks(profile(folder, "schema: public\n")) == []
    with pytest.raises(ConfigError, match="names no database_id"):
        resolve_masks(profile(folder, "masks_file: data-masking-policy.yml\n"))
    with pytest.raises(ConfigError, match="only harbour"):
        resolve_masks(profile(folder, "database_id: other\n"))


def test_masks_file_errors(tmp_path):
    path = tmp_path / "m.yml"
    path.write_text("version: 2\n")
    with pytest.raises(ConfigError, match="has version 2"):
        load_masks_file(path)
    path.write_text("::: [\n")
    with pytest.raises(ConfigError, match="is no YAML"):
        load_masks_file(path)
    with pytest.raises(FileNotFoundError):
        load_masks_file(tmp_path / "none.yml")


def test_discovery_stops_at_the_repository(folder):
    inner = folder / "sub" / "inner"
    inner.mkdir(parents=True)
    assert discover_masks_file(inner) == folder / "data-masking-policy.yml"
    (folder / "sub" / ".git").mkdir()
    assert discover_masks_file(inner) is None


def test_precedence_and_policy(folder):
    r = Resolution("flag.yml", "profile.yml", ["a"], ["b"], "/w")
    assert str(r.resolve()[0]) == "/w/flag.yml" and r.resolve()[1] == ["a"]
    assert Resolution("", "profile.yml", [], ["b"], "/w").resolve()[1] == ["b"]
    assert Resolution("x", disabled=True).resolve() == (None, [])
    p = Policy("harbour", {"north.captains.title": "1", "cargo.worth": "2", "bad": "3"})
    assert p.is_sensitive("north", "captains", "title") and p.is_sensitive("x", "cargo", "worth") and not p.is_sensitive("x", "captains", "title")
    with pytest.raises(ConfigError, match="none of the policies"):
        load_policy(folder / "data-masking-policy.yml", "harbour", ["nothing"])


def test_profile_environment(folder, monkeypatch):
    monkeypatch.setenv("SLICE_DB", "here")
    assert profile(folder, "connection: jdbc:${SLICE_DB}/$SLICE_DB\n").connection == "jdbc:here/here"
    with pytest.raises(ConfigError, match=r"\$\{SLICE_NONE\}"):
        profile(folder, "connection: ${SLICE_NONE}\n")
    assert Profile().folder == ""
