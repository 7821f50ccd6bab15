"""Names, paths and addresses as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters that a file or table name must not hold.
UNSAFE_CLASS = r"""[\\/:*?"<>|'%;#&=+$,()\[\]{}@!^~` _]+"""
# Extensions of files that travel with a source, of text-like files, and prefixes of remote sources.
SIDECAR_EXTENSIONS = (".qml", ".sld", ".tfw", ".pgw", ".jgw", ".gw", ".wld", ".aux.xml")
TEXT_EXTENSIONS = (".qgs", ".qml", ".xml", ".csv", ".txt", ".json", ".geojson", ".yml", ".yaml", ".md", ".html", ".sld", ".prj", ".py")
REMOTE_PREFIXES = ("wms:", "wmts:", "xyz:", "wcs:", "wfs:", "http://", "https://", "postgresql:", "postgis:")
REMOTE_RASTERS = ("wms:", "wmts:", "xyz:", "wcs:", "http://", "https://")
BUNDLE_PREFIX = "bundle://"


def sanitized(name: Column, most: int = 255) -> Column:
    """Unsafe characters and runs of them become one underscore; ends are stripped; nothing left is 'unnamed'."""
    clean = F.btrim(F.regexp_replace(F.coalesce(name, F.lit("")), UNSAFE_CLASS, "_"), F.lit("_ "))
    cut = F.when(F.length(clean) > most, F.rtrim(F.substring(clean, 1, most), F.lit("_"))).otherwise(clean)
    return F.when(cut == "", F.lit("unnamed")).otherwise(cut)


def table_name(name: Column) -> Column:
    return sanitized(name, 63)


def from_template(template: str, name: Column, crs: Column, run_ts: Column) -> Column:
    """{layer_name} {date} {time} {crs} {datetime} in a naming pattern, sanitised; a blank pattern is the name alone."""
    out = F.lit(template.strip() or "{layer_name}")
    values = {
        "{layer_name}": F.coalesce(name, F.lit("")),
        "{date}": F.date_format(run_ts, "yyyy-MM-dd"),
        "{time}": F.date_format(run_ts, "HHmmss"),
        "{crs}": F.coalesce(F.nullif(crs, F.lit("")), F.lit("no_crs")),
        "{datetime}": F.date_format(run_ts, "yyyy-MM-dd_HHmmss"),
    }
    for mark, value in values.items():
        out = F.replace(out, F.lit(mark), value)
    return sanitized(out)


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    """The last dot and what follows, unless the dot starts the name."""
    return F.regexp_extract(basename(path), r"^.+?(\.[^.]*)$", 1)


def stem(path: Column) -> Column:
    """The path without its extension."""
    return F.substr(path, F.lit(1), F.length(path) - F.length(extension(path)))


def entry_type(name: Column) -> Column:
    """The kind of a snapshot entry by its name; the first match wins."""
    return (
        F.when(name == "project.qgs", "project")
        .when(name == "manifest.json", "manifest")
        .when(name.isin("layer_tree.json", "open_in_arcgis_pro.py"), "arcpy")
        .when(name.startswith("vectors/") | name.startswith("vector/"), "vector")
        .when(name.startswith("rasters/") | name.startswith("raster/"), "raster")
        .when(name.endswith(".qml") | name.endswith(".sld"), "style")
        .otherwise("resource")
    )


def to_bundle_uri(name: Column) -> Column:
    return F.concat(F.lit(BUNDLE_PREFIX), name)


def from_bundle_uri(uri: Column) -> Column:
    return F.when(uri.startswith(BUNDLE_PREFIX), F.substr(uri, F.lit(len(BUNDLE_PREFIX) + 1)))


def text_like(name: Column) -> Column:
    return F.lower(extension(name)).isin(*TEXT_EXTENSIONS)


def layer_address(path: Column, layer: Column) -> Column:
    """Path and layer of a container; names with blanks, quotes, bars or backslashes are quoted."""
    quoted = F.concat(path, F.lit('|layername="'), F.replace(layer, F.lit('"'), F.lit('""')), F.lit('"'))
    plain = F.concat(path, F.lit("|layername="), layer)
    return F.when(F.coalesce(layer, F.lit("")) == "", path).when(F.rlike(layer, F.lit(r"""["'|\\\s]""")), quoted).otherwise(plain)


def restore_folder(path: Column) -> Column:
    return F.concat(stem(path), F.lit("_files"))


def relative_to(path: Column, root: str) -> Column:
    return F.substr(path, F.lit(len(root.rstrip("/")) + 2))


def starts_with_any(value: Column, prefixes) -> Column:
    found = F.lit(False)
    for p in prefixes:
        found = found | F.startswith(value, F.lit(p))
    return found


def source_class(source: Column) -> Column:
    """'scratch' (empty), 'remote' or 'file' for a source string, after what follows a bar is cut off."""
    plain = F.trim(F.element_at(F.split(F.coalesce(source, F.lit("")), r"\|"), 1))
    return F.when(plain == "", "scratch").when(starts_with_any(plain, REMOTE_PREFIXES), "remote").otherwise("file")


def source_path(source: Column, project_folder: str) -> Column:
    """The file that a source string names, or null: container addresses are unwrapped, relative paths completed."""
    plain = F.trim(F.element_at(F.split(F.coalesce(source, F.lit("")), r"\|"), 1))
    inner = F.regexp_extract(plain, r"^GPKG:(.*?)(?::[^:]*)?$", 1)
    path = F.when(plain.startswith("GPKG:"), inner).otherwise(plain)
    full = F.when(path.startswith("/"), path).otherwise(F.concat(F.lit(project_folder.rstrip("/") + "/"), F.regexp_replace(path, r"^(\./)+", "")))
    return F.when((plain == "") | starts_with_any(plain, REMOTE_PREFIXES), F.lit(None).cast("string")).otherwise(full)
