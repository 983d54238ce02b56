"""Commands print what the functions return, and say by their exit code how it went."""

from dataclasses import replace

from bilens import catalog, cli


def test_commands(spark, sf, capsys, tmp_path):
    assert cli.main(["describe", f"{sf}/region.parquet", "region", "--key", "r_regionkey"]) == 0
    assert "Field('r_name', 'string'" in capsys.readouterr().out
    assert cli.main(["diagram", "bilens.catalog:ENTITIES", "--overview", "--out", str(tmp_path / "o.mmd")]) == 0
    assert (tmp_path / "o.mmd").read_text().startswith("flowchart")
    assert cli.main(["diagram", "bilens.catalog:PLACES"]) == 0 and "customer" in capsys.readouterr().out
    assert cli.main(["lineage", "bilens.catalog:PLACES"]) == 0 and "columnLineage" in capsys.readouterr().out
    assert cli.main(["plan", "bilens.catalog:RENAMED", "--data", sf]) == 0 and "view people" in capsys.readouterr().out


def test_observed_keys_and_domains(spark, sf, capsys, monkeypatch):
    assert cli.main(["describe", f"{sf}/customer.parquet", "customer", "--observe", "1"]) == 0
    said = capsys.readouterr().out
    assert "observed" in said and "primary_key=('c_custkey',)" in said and "('c_name',)" in said
    monkeypatch.setattr(catalog, "SOME", [replace(catalog.RENAMED, domain="people"), replace(catalog.NARROW, domain="sales")], raising=False)
    assert cli.main(["check", "bilens.catalog:SOME", "--no-data"]) == 1
    assert cli.main(["check", "bilens.catalog:SOME", "--no-data", "--domain", "people"]) == 0
    said = capsys.readouterr().out.splitlines()
    assert cli.main(["check", "bilens.catalog:SOME", "--no-data", "--domain", "none"]) == 0 and any(" people " in line for line in said)


def test_exit_codes(spark, sf, capsys):
    assert cli.main(["check", "bilens.catalog:RENAMED", "--data", sf]) == 0
    assert cli.main(["check", "bilens.catalog:NARROW", "--data", sf]) == 1 and "refused narrow_status" in capsys.readouterr().out
    assert cli.main(["check", "bilens.catalog:NUMBERED_LINES", "--data", sf]) == 1 and "identity order_no, line_no" in capsys.readouterr().out
    assert cli.main(["check", "bilens.catalog:RENAMED", "--data", "/nowhere"]) == 2
    assert cli.main(["check", "bilens.catalog:RENAMED", "--no-data"]) == 0
