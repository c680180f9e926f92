"""Messages of uploads: every field of every kind."""

from pyspark.sql import functions as F

from lodewright.sources import messages as m


def element(tag, fields, inner=""):
    return f"<{tag}>" + "".join(f"<{k}>{v}</{k}>" for k, v in fields.items()) + inner + f"</{tag}>"


def filled(names, tag):
    return {n: f"{tag} {n}" for n in names}


NESTED = '<row n="1">text<b/></row><row n="2">a &amp; b</row>'


def written(tmp_path):
    """One file of each kind, and odd ones."""
    item = lambda k: element("item", {**filled(m.ITEM, f"i{k}"), "attributes_xml": NESTED, "table_parts": "<part><line>1</line></part>"})
    variant = lambda k, skip=(): element("item", {n: v for n, v in filled(m.NOMENCLATURE_ITEM, f"n{k}").items() if n not in skip})
    texts = {
        "handshake": '<?xml version="1.0" encoding="UTF-8"?>\n<!-- first -->\n' + element("handshake", {**filled(m.HANDSHAKE, "h"), "iteration_number": "3"}),
        "metadata": element("metadata", filled(m.METADATA, "m")),
        "constant": element("constant", {**filled(m.CONSTANT, "c"), "value": NESTED}),
        "catalog_meta": element("catalog_meta", filled(m.CATALOG_META, "t")),
        "catalog_item": element("catalog_item", {**filled(m.CATALOG_ITEM, "s"), "attributes_xml": NESTED}),
        "catalog_items": element("catalog_items", {"upload_uuid": "u1", "catalog_name": "Номенклатура"}, "<items>" + item(1) + item(2) + "</items>"),
        "nomenclature_batch": element("nomenclature_batch", {"upload_uuid": "u1", "database_id": "7", "timestamp": "now"}, "<items>" + variant(1) + variant(2, ("timestamp", "characteristic_name")) + "</items>"),
        "complete": element("complete", filled(m.COMPLETE, "e")),
        "unknown": "<other><a>1</a></other>",
        "bad": "<constant><name>no end",
        "empty": "",
        "one": element("catalog_items", {"upload_uuid": "u1", "catalog_name": "x"}, "<items>" + item(3) + "</items>"),
        "none": element("catalog_items", {"upload_uuid": "u1", "catalog_name": "x"}),
    }
    for name, text in texts.items():
        (tmp_path / f"{name}.xml").write_text(text, encoding="utf-8")


def test_every_field_of_every_kind(spark, tmp_path):
    written(tmp_path)
    read = m.read_messages(spark, str(tmp_path)).cache()
    kinds = {r.file.rsplit("/", 1)[1][:-4]: r.kind for r in read.collect()}
    assert kinds == {**{k: k for k in m.KINDS}, "unknown": "unknown", "bad": "bad", "one": "catalog_items", "none": "catalog_items"}
    h = m.of_kind(read, "handshake").first()
    assert h.iteration_number == 3 and all(h[n] == f"h {n}" for n in m.HANDSHAKE if n != "iteration_number")
    for kind, tag in (("metadata", "m"), ("catalog_meta", "t"), ("complete", "e")):
        assert m.of_kind(read, kind).first().asDict() == filled(m.KINDS[kind], tag)
    c = m.of_kind(read, "constant").first()
    assert c.value == '<row n="1">text<b></b></row><row n="2">a & b</row>' and c.synonym == "c synonym"
    items = {r.name: r for r in m.catalog_items(read).collect()}
    assert set(items) == {"s name", "i1 name", "i2 name", "i3 name"}
    assert items["s name"].upload_uuid == "s upload_uuid" and items["s name"].catalog_name == "s catalog_name" and items["s name"].table_parts_xml == "s table_parts"
    for k in (1, 2):
        r = items[f"i{k} name"]
        assert (r.upload_uuid, r.catalog_name, r.reference, r.code, r.timestamp) == ("u1", "Номенклатура", f"i{k} reference", f"i{k} code", f"i{k} timestamp")
        assert r.attributes_xml == c.value and r.table_parts_xml == "<part><line>1</line></part>"
    variants = {r.nomenclature_name: r for r in m.nomenclature_items(read).collect()}
    first, second = variants["n1 nomenclature_name"], variants["n2 nomenclature_name"]
    assert first.timestamp == "n1 timestamp" and second.timestamp == "now" and second.characteristic_name is None
    assert all(v.upload_uuid == "u1" and v.database_id == "7" and None not in (v.nomenclature_reference, v.nomenclature_code, v.characteristic_reference, v.attributes_xml, v.table_parts_xml) for v in variants.values())


def test_summary_of_uploads(spark, tmp_path):
    written(tmp_path)
    told = {r.upload_uuid: (r.constants, r.catalogs, r.items, r.complete) for r in m.upload_summary(m.read_messages(spark, str(tmp_path))).collect()}
    assert told["u1"] == (0, 0, 5, False) and told["c upload_uuid"] == (1, 0, 0, False) and told["t upload_uuid"] == (0, 1, 0, False) and told["e upload_uuid"] == (0, 0, 0, True)


def test_kinds_behind_odd_beginnings(spark):
    texts = ["﻿<complete><upload_uuid>u</upload_uuid></complete>", "  <!-- a > b --><complete/>", "<n:complete xmlns:n='x'><upload_uuid>u</upload_uuid></n:complete>", None]
    got = spark.createDataFrame([(t,) for t in texts], "value string").select(m.kind_of(F.col("value")).alias("k")).collect()
    assert [r.k for r in got] == ["complete", "complete", "complete", None]
