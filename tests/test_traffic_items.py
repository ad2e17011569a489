"""Traffic items as they come: keys of odd types, missing places, all services, by road."""

import json

import pytest

from strom.sources import feeds


def write(folder, road, service, document):
    place = folder / f"road={road}" / f"service={service}"
    place.mkdir(parents=True)
    (place / "answer.json").write_text(json.dumps(document, indent=1), encoding="utf-8")


def test_items_of_all_services(spark, tmp_path):
    line = {"type": "LineString", "coordinates": [[9, 50], [9.5], "x", [999, 50], ["9.25", "50.5"]]}
    write(tmp_path, "A5", "roadworks", {"roadworks": [
        {"identifier": "r1", "title": "  Bau ", "subtitle": " Basel", "coordinate": {"lat": "49.5", "long": 8}, "geometry": line, "isBlocked": "true", "icon": "i", "extra": {"k": [1]},
         "description": ["Zeile", None, 3, " zwei "], "impact": {"symbols": [None, "CLOSED"]}, "delayTimeValue": "6", "display_type": "ROADWORKS"},
        {"identifier": "nowhere", "title": "x"}, "no object", {"identifier": "off", "coordinate": {"lat": 99, "long": 8}, "point": "49,8"}]})
    write(tmp_path, "A7", "warning", {"warning": [
        {"identifier": 7, "point": "50.25, 8.5", "abnormalTrafficType": "STATIONARY_TRAFFIC", "delayTimeValue": -1, "title": "", "impact": "none", "description": "text"},
        {"identifier": "w2", "geometry": line, "coordinate": {"lat": True, "long": 1}, "startTimestamp": "2026-03-01T08:00:00Z"}]})
    write(tmp_path, "A8", "closure", {"other": []})
    events = feeds.read_traffic_json(spark, str(tmp_path)).collect()
    found = {(r.external_id, r.road_name): r for r in events}
    assert sorted(found, key=str) == [("r1", "A5"), ("w2", "A7"), (None, "A7")]
    r, w, x = found["r1", "A5"], found["w2", "A7"], found[None, "A7"]
    assert (r.event_type, r.severity, r.direction, r.title, r.description, r.is_blocked, r.delay_minutes) == ("roadworks", "high", "Basel", "Bau", "Zeile\n zwei", True, 6.0)
    assert (r.latitude, r.longitude) == (49.5, 8.0) and [tuple(v) for v in r.geometry] == [(50.0, 9.0), (50.5, 9.25)]
    assert set(json.loads(r.raw)) == {"identifier", "title", "subtitle", "coordinate", "extra", "description", "impact", "delayTimeValue", "display_type"}
    assert json.loads(r.raw)["extra"] == {"k": [1]}
    assert (x.event_type, x.severity, x.title, x.delay_minutes, x.description, x.is_blocked) == ("congestion", "severe", "A7 warning", None, None, False)
    assert (x.latitude, x.longitude) == (50.25, 8.5) and (w.latitude, w.longitude) == (50.0, 9.0) and w.starts_at is not None


def test_service_that_is_no_list_is_an_error(spark, tmp_path):
    write(tmp_path, "A5", "closure", {"closure": "none"})
    with pytest.raises(Exception, match="INVALID_VARIANT_CAST"):
        feeds.read_traffic_json(spark, str(tmp_path)).collect()
