"""Late cells of a CSV."""

from tessera.sources.convert import load
from tessera.sources.csv import read_csv


def test_cells_after_a_thousand_rows_keep_their_values(spark, tmp_path):
    path = tmp_path / "late.csv"
    path.write_text("a,b,c\n" + "".join(f"{i},{i},{i}\n" for i in range(1500)) + "12.5,A17,7\n")
    for df in (read_csv(spark, str(path)), load(spark, str(path))):
        last = df.filter("b = 'A17'").collect()
        assert [(r.a, r.b, r.c) for r in last] == [(12.5, "A17", 7)]
        assert df.filter("a IS NULL OR b IS NULL OR c IS NULL").count() == 0
