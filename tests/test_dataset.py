import tablewright as tw
from tablewright.catalogs import SHOP
from tablewright.operators.cleanup import fk_clean_cascade


def test_generate_validate_clean_report(spark, tmp_path):
    catalog = SHOP.scaled(1, 1000)
    rows = tw.generate(spark, catalog, str(tmp_path / "data"))
    assert rows == {n: t.rows for n, t in catalog.tables.items()}
    tables = tw.read_dataset(spark, str(tmp_path / "data"), catalog)
    results = tw.validate(spark, catalog, tables)
    assert results["summary"].first().is_valid
    assert tuple(results["final_status"].first()) == (33, 33, 0)  # 32 references and one nullable
    assert results["issues"].isEmpty()

    # Lose a parent: its children's rows go, and the children of those.
    fewer = tables | {"Users": tables["Users"].where("user_id < 60")}
    cleaned = fk_clean_cascade(
        catalog, fewer, folder=str(tmp_path / "clean"), fmt="csv"
    )
    assert "Orders" in cleaned.rewritten and "Order_Items" in cleaned.rewritten
    assert "Payments" not in cleaned.rewritten
    after = tw.validate(spark, catalog, cleaned.tables)
    assert tuple(after["final_status"].first()) == (33, 33, 0)  # 32 references and one nullable
    assert tw.read_dataset(spark, str(tmp_path / "data"), catalog)["Orders"].count() == rows["Orders"]

    views = tw.report(spark, catalog, tables)
    assert views["totals"].first().total_rows == sum(rows.values())
    assert views["quality"].first().verdict == "PERFECT"
    assert views["foreign_keys"].count() == 33
    details = tw.table_details(catalog, "Orders", tables["Orders"])
    assert details["columns"].count() == 8 and details["sample"].count() == 5
