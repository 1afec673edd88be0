"""Where results go: text, JSON reports, office files with their text replaced, encrypted mappings."""

from __future__ import annotations

import datetime
import hashlib
import io
import json
import os
import re
import zipfile
from collections.abc import Callable
from pathlib import PurePath
from xml.etree import ElementTree
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.sources.documents import S, W, paragraph_text

MAGIC, SALT, NONCE, ROUNDS = b"DOCANON1", 32, 12, 600_000  # fixed values of the file format


def output_name(source: str, suffix: str, ending: str) -> str:
    """The name of a result beside its source; only the last ending of the source is dropped."""
    return f"{PurePath(source).stem}{suffix}.{ending}"


def write_texts(df: DataFrame, path: str, text: str = "masked", by: str = "source_file") -> None:
    """One folder per document, its text in one piece."""
    df.select(by, F.col(text).alias("value")).write.mode("overwrite").partitionBy(by).option("lineSep", "\n").text(path)


def write_reports(df: DataFrame, path: str, report: str = "report") -> None:
    df.select(F.col(report).alias("value")).write.mode("overwrite").text(path)


def replacer(mapping: dict[str, str]) -> Callable[[str], str]:
    order = sorted((k for k in mapping if k), key=len, reverse=True)

    def run(text: str) -> str:
        for k in order:
            text = text.replace(k, mapping[k])
        return text

    return run


def docx_masked(content: bytes, mapping: dict[str, str]) -> bytes:
    """A Word file with the dictionary applied to every paragraph of its body, tables, headers and footers.

    A changed paragraph's text goes into its first run; the others become empty, so that styles stay.
    """
    put = replacer(mapping)
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(content)) as z, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as w:
        for item in z.infolist():
            data = z.read(item)
            if re.fullmatch(r"word/(?:document|header\d*|footer\d*)\.xml", item.filename):
                root = ElementTree.fromstring(data)
                for p in root.iter(W + "p"):
                    old = paragraph_text(p)
                    if (new := put(old)) != old:
                        texts = list(p.iter(W + "t"))
                        for k, t in enumerate(texts):
                            t.text = new if k == 0 else ""
                data = ElementTree.tostring(root, encoding="utf-8", xml_declaration=True)
            w.writestr(item, data)
    return out.getvalue()


def xlsx_masked(content: bytes, mapping: dict[str, str], value_of: Callable[[str, str], str] = lambda v, kind: v) -> bytes:
    """A workbook with the dictionary applied to every cell that isn't a formula; changed cells become text, others stay as they are."""
    put, out = replacer(mapping), io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(content)) as z, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as w:
        shared = [] if "xl/sharedStrings.xml" not in z.namelist() else ["".join(t.text or "" for t in si.iter(S + "t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))]
        for item in z.infolist():
            data = z.read(item)
            if item.filename.startswith("xl/worksheets/") and item.filename.endswith(".xml"):
                root = ElementTree.fromstring(data)
                for c in root.iter(S + "c"):
                    kind, v = c.get("t", "n"), c.findtext(S + "v")
                    if c.find(S + "f") is not None or kind != "inlineStr" and v is None:
                        continue
                    old = "".join(t.text or "" for t in c.iter(S + "t")) if kind == "inlineStr" else shared[int(v)] if kind == "s" else v
                    if kind == "n" and re.fullmatch(r"-?\d+\.0+", old):
                        old = old.split(".")[0]
                    if old.startswith("=") or (new := put(old)) == old:
                        continue
                    for child in list(c):
                        c.remove(child)
                    c.set("t", "inlineStr")
                    ElementTree.SubElement(ElementTree.SubElement(c, S + "is"), S + "t").text = new
                data = ElementTree.tostring(root, encoding="utf-8", xml_declaration=True)
            w.writestr(item, data)
    return out.getvalue()


def line_style(line: str) -> str | None:
    """Heading 1 for short lines in capitals, Heading 2 for lines that begin like a title."""
    if line.isupper() and 3 < len(line) < 80:
        return "Heading1"
    return "Heading2" if re.match(r"#{1,3}\s|ДОГОВОР|Договор|Отчет|ОТЧЕТ", line) else None


def docx_from_text(text: str) -> bytes:
    """A new Word file with a paragraph for each line."""
    body = "".join(f'<w:p>{f"<w:pPr><w:pStyle w:val={chr(34)}{s}{chr(34)}/></w:pPr>" if (s := line_style(x.strip())) else ""}<w:r><w:t xml:space="preserve">{escape(x)}</w:t></w:r></w:p>' for x in text.split("\n"))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", '<?xml version="1.0" encoding="UTF-8"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>')
        z.writestr("_rels/.rels", '<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>')
        z.writestr("word/document.xml", f'<?xml version="1.0" encoding="UTF-8"?><w:document xmlns:w="{W[1:-1]}"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def _key(password: str, salt: bytes) -> bytes:
    return hashlib.pbkdf2_hmac("sha256", password.encode(), salt, ROUNDS, 32)


def save_mapping(mapping: DataFrame, path: str, password: str) -> str:
    """Encrypt a mapping into one file: magic, salt, nonce, then AES-256-GCM over JSON.

    For one batch's mapping, which has to fit the driver as the file format is a single message; at scale keep the mapping
    as a table. The key goes to the cipher as data, so no plan shows it.
    """
    spark = mapping.sparkSession
    rows = [r.asDict() for r in mapping.select("original", "label", "placeholder", "primary", "canonical", "files").collect()]
    content = {"version": 2, "created": datetime.datetime.now(datetime.UTC).isoformat(), "total_entities": len({r["placeholder"] for r in rows}), "total_surfaces": len(rows), "mapping": {r["original"]: r["placeholder"] for r in rows}, "primary": {r["placeholder"]: r["primary"] for r in rows}}
    salt, nonce = os.urandom(SALT), os.urandom(NONCE)
    one = spark.createDataFrame([(bytearray(json.dumps(content, ensure_ascii=False).encode()), bytearray(_key(password, salt)), bytearray(nonce))], "v binary, k binary, n binary")
    sealed = bytes(one.select(F.expr("aes_encrypt(v, k, 'GCM', 'DEFAULT', n)").alias("x")).first()["x"])
    path = path if path.endswith(".mapenc") else os.path.splitext(path)[0] + ".mapenc"
    with open(path, "wb") as f:
        f.write(MAGIC + salt + sealed)  # the cipher's output begins with the nonce
    return path


def load_mapping(spark: SparkSession, path: str, password: str) -> DataFrame:
    """(original, label, placeholder, primary) of an encrypted file; ValueError for another file or a wrong password."""
    with open(path, "rb") as f:
        data = f.read()
    if not data.startswith(MAGIC):
        raise ValueError("not an encrypted mapping")
    salt, sealed = data[len(MAGIC) : len(MAGIC) + SALT], data[len(MAGIC) + SALT :]
    one = spark.createDataFrame([(bytearray(sealed), bytearray(_key(password, salt)))], "v binary, k binary")
    opened = one.select(F.expr("try_aes_decrypt(v, k, 'GCM')").alias("x")).first()["x"]
    if opened is None:
        raise ValueError("wrong password or damaged file")
    content = json.loads(bytes(opened))
    found = content["mapping"]
    primary = content.get("primary") or {ph: max((o for o, p in found.items() if p == ph), key=lambda o: len(o.split())) for ph in set(found.values())}
    rows = [(o, re.sub(r"_\d+$", "", ph.strip("<>")), ph, primary[ph]) for o, ph in found.items()]
    return spark.createDataFrame(rows, "original string, label string, placeholder string, primary string")
