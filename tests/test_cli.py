from __future__ import annotations

import pytest
from sample import CUSTOMERS, INVOICES, LEDGER, write_extracts

from quittance.__main__ import main
from quittance.plans import export
from quittance.sources import csv_files


def test_load_deploy_check_export(spark, tmp_path, capsys):
    root = ["--root", str(tmp_path / "warehouse")]
    extracts = write_extracts(tmp_path / "extracts")
    assert main(["load", *root, "--csv", extracts]) == 0
    assert main(["dev", *root]) == 0
    assert main(["status", *root]) == 0
    assert "unknown" in capsys.readouterr().out
    assert main(["deploy", *root]) == 0
    assert main(["status", *root]) == 0
    assert "prod_blue" in capsys.readouterr().out
    assert main(["check", *root]) == 0
    out = str(tmp_path / "out")
    assert main(["export", *root, "--out", out, "--ordered"]) == 0
    assert spark.read.json(export.rows_folder(spark, out)).count() == len(LEDGER)
    assert spark.table("public.mart_invoice_ledger").count() == len(LEDGER)

    bad = write_extracts(tmp_path / "bad", invoices=INVOICES.replace("paid", "sent"))
    assert main(["load", *root, "--csv", bad]) == 0
    assert main(["deploy", *root]) == 1
    assert "not published" in capsys.readouterr().out
    assert main(["status", *root]) == 0
    assert "prod_blue" in capsys.readouterr().out
    assert main(["prune", *root, "--keep", "1"]) == 0
    assert main(["check", *root]) == 0
    assert main(["clean", *root]) == 0
    assert not spark.catalog.tableExists("public.mart_invoice_ledger")


def test_every_check_is_shown(spark, tmp_path, capsys):
    root = ["--root", str(tmp_path / "warehouse")]
    assert main(["load", *root, "--csv", write_extracts(tmp_path / "extracts")]) == 0
    assert main(["deploy", *root]) == 0
    capsys.readouterr()
    assert main(["check", *root]) == 0
    assert len(capsys.readouterr().out.splitlines()) == 48


def test_line_breaks_are_loaded_on_demand(spark, tmp_path):
    text = CUSTOMERS + '16,"Two\nLines",se,SMB,\n'
    extracts = write_extracts(tmp_path / "extracts", customers=text)
    load = ["load", "--root", str(tmp_path / "warehouse"), "--csv", extracts]
    with pytest.raises(Exception, match="MALFORMED_RECORD"):
        main(load)
    assert main([*load, "--line-breaks"]) == 0
    raw = csv_files.read_raw(spark, str(tmp_path / "warehouse" / "raw"))
    assert raw["customers"].where("customer_id = 16").first()["customer_name"] == "Two\nLines"


def test_missing_arguments():
    with pytest.raises(SystemExit):
        main(["load", "--root", "x"])
