import functools

import pytest

from tessera import __main__ as commands
from tessera.plans import linkage


def toy(tmp_path):
    """Files s1, s2 and gold of 40 entities, each with a record in another spelling."""
    head = "entity_id\tbusiness_name\tbusiness_address\tcountry\n"
    towns = "Chennai Pune Kolkata Mumbai Delhi Jaipur Surat Nagpur".split()
    names = [f"{a} {b}" for a in ("Sharma", "Perfect", "Global", "Ahuja", "Lotus") for b in ("Traders", "Health", "Foods", "Projects", "Textiles", "Motors", "Press", "Steel")]
    s1, s2, gold = head, head, "source1_entity_id\tmatched_entity_ids\n"
    for i, n in enumerate(names):
        s1 += f"S1-{i}\t{n} Pvt Ltd\t{i + 10} Gandhi Road, {towns[i % 8]}, 6000{i + 10}\tIndia\n"
        s2 += f"S2-{i}\t{n.upper()} Private Limited\t{i + 10} Gandhi Rd, {towns[i % 8]}\tIndia\n"
        gold += f"S1-{i}\tS2-{i}\n"
    for name, text in (("s1", s1), ("s2", s2), ("gold", gold)):
        (tmp_path / f"{name}.tsv").write_text(text)
    return names, lambda name: str(tmp_path / name)


def lines_of(folder):
    return dict(line.split("\t") for p in folder.glob("part-*") for line in p.read_text().splitlines() if line.startswith("S1-"))


def test_link_and_check(spark, tmp_path, capsys):
    names, at = toy(tmp_path)
    assert commands.main(["link", "--s1", at("s1.tsv"), "--others", at("s2.tsv"), "--gold", at("gold.tsv"), "--out", at("out"), "--first"]) == 0
    rows = lines_of(tmp_path / "out")
    assert len(rows) == len(names) and sum(rows[f"S1-{i}"] == f"S2-{i}" for i in range(len(names))) > 0.8 * len(names)
    assert commands.main(["check", "--result", at("out"), "--s1", at("s1.tsv"), "--valid", at("s2.tsv")]) == 0
    (tmp_path / "bad.tsv").write_text("source1_entity_id\tmatched_entity_ids\nS1-0\tS2-0,S2-0\nS1-99\tS2-1\n")
    assert commands.main(["check", "--result", at("bad.tsv"), "--s1", at("s1.tsv")]) == 1
    assert "duplicate id" in capsys.readouterr().out


def test_fit_predict_and_recut(spark, tmp_path, monkeypatch, capsys):
    """Models fitted on one split link another, without its owners; a candidate file, other rules and blank countries."""
    names, at = toy(tmp_path)
    settings = linkage.Settings(rounds=3, least_words=2, tune_pct=30, report_pct=30)
    monkeypatch.setattr(linkage, "fit_v3", functools.partial(linkage.fit_v3, settings=settings))
    files = ["--s1", at("s1.tsv"), "--others", at("s2.tsv"), at("none.tsv")]
    with pytest.warns(UserWarning, match="none.tsv is missing"):
        assert commands.main(["fit", *files, "--gold", at("gold.tsv"), "--model", at("model")]) == 0
    assert commands.main(["fit", *files, "--gold", at("gold.tsv"), "--model", at("model")]) == 0
    assert "skip" in capsys.readouterr().out
    assert commands.main(["predict", *files, "--model", at("model"), "--pairs", at("pairs"), "--out", at("out")]) == 0
    found, candidates = lines_of(tmp_path / "out/matching_results.tsv"), lines_of(tmp_path / "out/candidate_pairs.tsv")
    assert len(found) == len(candidates) == len(names)
    assert all(set(filter(None, found[k].split(","))) <= set(candidates[k].split(",")) for k in found)
    assert all(f"S2-{i}" in candidates[f"S1-{i}"].split(",") for i in range(len(names)))
    assert commands.main(["check", "--result", at("out/matching_results.tsv"), "--s1", at("s1.tsv"), "--candidates", at("out/candidate_pairs.tsv")]) == 0
    recut = ["recut", "--s1", at("s1.tsv"), "--model", at("model"), "--pairs", at("pairs")]
    assert commands.main([*recut, "--out", at("all"), "--thr", "0"]) == 0
    every = lines_of(tmp_path / "all/matching_results.tsv")
    assert sum(f"S2-{i}" in every[f"S1-{i}"].split(",") for i in range(len(names))) > 0.9 * len(names)
    assert commands.main([*recut, "--out", at("blank"), "--thr", "0", "--blank", "India"]) == 0
    assert set(lines_of(tmp_path / "blank/matching_results.tsv").values()) == {""} and lines_of(tmp_path / "blank/candidate_pairs.tsv") == candidates


def test_probe(spark, tmp_path, capsys):
    (tmp_path / "s1.tsv").write_text("entity_id\tbusiness_name\tbusiness_address\tcountry\nS1-0\ta\tb\tIndia\nS1-1\ta\tb\tUS\nS1-2\ta\tb\tIndia\nS1-3\ta\tb\tUS\n")
    (tmp_path / "r.tsv").write_text("source1_entity_id\tmatched_entity_ids\nS1-0\tS2-0\nS1-1\tS2-1,S3-1\nS1-2\t\nS1-9\tS2-9\n")
    (tmp_path / "c.tsv").write_text("source1_entity_id\tcandidate_entity_ids\nS1-0\tS2-0\n")
    at = lambda name: str(tmp_path / name)
    assert commands.main(["probe", "--result", at("r.tsv"), "--s1", at("s1.tsv"), "--blank", "India,FR", "--out", at("p"), "--candidates", at("c.tsv")]) == 0
    assert lines_of(tmp_path / "p/matching_results.tsv") == {"S1-0": "", "S1-1": "S2-1,S3-1", "S1-2": "", "S1-9": "S2-9"}
    assert lines_of(tmp_path / "p/candidate_pairs.tsv") == {"S1-0": "S2-0"}
    printed = capsys.readouterr().out
    assert "India: blanked, 2 entities (0.5000 of all), 1 lines" in printed and "US: kept, 2 entities (0.5000 of all), 1 lines" in printed
