import datetime as dt

from emberfall.sources.observations import FILE_WIDTH, read_observations
from emberfall.sources.stations import read_stations, with_coordinates
from emberfall.sources.tables import load_table, save_table


def line(date, station, ta, rn, between=","):
    cells = ["0"] * FILE_WIDTH
    cells[0], cells[1], cells[11], cells[38] = date, station, ta, rn
    return between.join(cells)


def test_commas_and_blanks_give_the_same_rows(spark, tmp_path):
    days = [("20000101", "90", "12.5", "-9.0"), ("20000102", "90", "NaN", "Infinity"), ("20000103", "90", "-Infinity", "nan"), ("20000104", "90", "-99.0", "2")]
    found = []
    for i, between in enumerate([",", "   ", " , ", "\t"]):
        folder = tmp_path / str(i)
        folder.mkdir()
        text = "\n".join(["# head", *[" " * i + line(*d, between) for d in days], "", "#7777END"])
        (folder / "asos_1.csv").write_text(text)
        found.append(sorted((r.date.day, r.ID, r.TA, r.RN) for r in read_observations(spark, str(folder)).collect()))
    assert found[0] == [(1, 90, 12.5, 0.0), (2, 90, None, None), (3, 90, None, None), (4, 90, None, 2.0)]
    assert all(f == found[0] for f in found)


def test_station_files(spark, tmp_path):
    header = ["#START7777", "# c1", "# c2", "# c3", "# c4"]
    (tmp_path / "asos_90.csv").write_text(
        "\n".join(
            header
            + [
                line("20000101", "90", "12.5", "-9.0"),
                line("20000102", "90", "-99.0", "3.5"),
                line("20000103", "90", "x", "x"),
                "20000104,90,0,0,0,0,0,0,0,0,0,7.5",
                "#7777END",
            ]
        )
        + "\n"
    )
    (tmp_path / "asos_93.csv").write_text(
        "\n".join(header + [line("20000102", "93", "1.0", "0.0"), "end,of,file"]) + "\n"
    )
    (tmp_path / "notes.csv").write_text(line("20000102", "1", "1.0", "0.0") + "\n")
    rows = {
        (r.ID, r.date): (r.TA, r.RN)
        for r in read_observations(spark, str(tmp_path)).collect()
    }
    day = lambda d: dt.date(2000, 1, d)
    assert rows == {
        (90, day(1)): (12.5, 0.0),
        (90, day(2)): (None, 3.5),
        (90, day(3)): (None, None),
        (90, day(4)): (7.5, None),
        (93, day(2)): (1.0, 0.0),
    }
    bounded = read_observations(spark, str(tmp_path), start="2000-01-02", end="2000-01-03")
    assert bounded.count() == 3


def test_station_list_drops_index_and_joins_left(spark, tmp_path):
    path = tmp_path / "stations.csv"
    path.write_bytes(b",STN_ID,Long,Lat\r\n0,90,128.5,38.25\r\n1,93,127.75,37.9\r\n")
    stations = read_stations(spark, str(path))
    assert stations.columns == ["STN_ID", "Long", "Lat"]
    days = spark.createDataFrame([(90,), (91,)], "ID int")
    found = {r.ID: r.Long for r in with_coordinates(days, stations).collect()}
    assert found == {90: 128.5, 91: None}


def test_saved_table_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, 2000, 3.0), (2, 2001, None)], "ID int, year int, x double")
    save_table(df, str(tmp_path / "t"), ["year"])
    save_table(df, str(tmp_path / "t"), ["year"])
    assert sorted(load_table(spark, str(tmp_path / "t")).select("ID", "year", "x").collect()) == sorted(
        df.collect()
    )
