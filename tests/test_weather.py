"""Decoded weather reports against literal ones."""

from fieldloom.functions import weather


def told(spark, report, lang="en", more=None):
    rows = weather.decoded(spark.createDataFrame([(report, lang)], "report string, lang string"), "report", "lang", more).orderBy("pos").collect()
    return [(r.token, r.text) for r in rows]


def test_a_whole_report_in_two_languages(spark):
    report = "METAR EDNY 090950Z 06004KT 9999 FEW044 25/14 Q1017"
    assert [t for _, t in told(spark, report)] == [
        "Routine observation", "Station: EDNY", "Observed day 9, 09:50 UTC", "Wind from 60° at 4 kt", "Visibility: 10 km or more", "Few clouds at 4400 ft",
        "Temperature 25 °C, dew point 14 °C", "QNH 1017 hPa",
    ]
    assert dict(told(spark, report, "de"))["06004KT"] == "Wind aus 60° um 4 kt"


def test_forecast_groups_weather_and_unknown_ones(spark):
    got = told(spark, " TAF EDNY 090800Z 0909/0918 28015G27KT -SHRA +TSRA M02/M05 TEMPO VRB03KT 00000KT A2992 NSW XYZ123 AUTO EDDF RMK METAR= ")
    assert dict(got) == {
        "TAF": "Terminal aerodrome forecast", "EDNY": "Station: EDNY", "090800Z": "Observed day 9, 08:00 UTC", "0909/0918": "Valid from 9. 09:00 to 9. 18:00 UTC",
        "28015G27KT": "Wind from 280° at 15 kt, gusting 27 kt", "-SHRA": "Light showers of rain", "+TSRA": "Heavy thunderstorm rain",
        "M02/M05": "Temperature -2 °C, dew point -5 °C", "TEMPO": "Temporarily:", "VRB03KT": "Wind variable at 3 kt", "00000KT": "Wind calm",
        "A2992": "Altimeter 29.92 inHg", "NSW": "NS W", "XYZ123": "", "AUTO": "Automated station", "EDDF": "",
    }


def test_other_languages_are_given_and_fall_back_to_english(spark):
    more = {"xx": {"calm": "still", "RA": "wet"}}
    assert told(spark, "00000KT -RASN 9999", "xx", more) == [("00000KT", "still"), ("-RASN", "Light wet snow"), ("9999", "Visibility: 10 km or more")]
    assert told(spark, "00000KT", None) == [("00000KT", "Wind calm")]


def test_nothing_gives_nothing(spark):
    assert told(spark, None) == told(spark, "") == told(spark, " = ") == told(spark, "RMK AO2") == []
