"""Files through the file system that Spark uses, so that nothing lies on the driver's own disk alone."""

from __future__ import annotations

import re

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    """(file system, path) of the JVM."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def exists(spark: SparkSession, path: str) -> bool:
    fs, target = _at(spark, path)
    return fs.exists(target)


def is_file(spark: SparkSession, path: str) -> bool:
    fs, target = _at(spark, path)
    return fs.exists(target) and fs.getFileStatus(target).isFile()


def remove(spark: SparkSession, path: str) -> None:
    fs, target = _at(spark, path)
    fs.delete(target, True)


def move(spark: SparkSession, path: str, to: str) -> None:
    """Rename a file or folder within one file system; folders above its new place are made."""
    fs, source = _at(spark, path)
    _, target = _at(spark, to)
    fs.mkdirs(target.getParent())
    if not fs.rename(source, target):
        raise OSError(f"{path} could not be moved to {to}")


def _created(spark: SparkSession, path: str):
    fs, target = _at(spark, path)
    fs.setWriteChecksum(False)  # no checksum file beside a local one
    return fs.create(target, True)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    out = _created(spark, path)
    out.write(bytearray(text.encode()))
    out.close()


def join_parts(spark: SparkSession, folder: str, path: str) -> str:
    """The folder's part files, in the order of their names, as one file; streams, block by block. Its SHA-256."""
    fs, source = _at(spark, folder)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    digest = jvm.java.security.MessageDigest.getInstance("SHA-256")
    out = jvm.java.security.DigestOutputStream(_created(spark, path), digest)
    for part in sorted((s.getPath() for s in fs.listStatus(source) if s.getPath().getName().startswith("part-")), key=lambda p: p.getName()):
        read = fs.open(part)
        jvm.org.apache.hadoop.io.IOUtils.copyBytes(read, out, conf, False)
        read.close()
    out.close()
    return jvm.org.apache.commons.codec.binary.Hex.encodeHexString(digest.digest())


def sha256(spark: SparkSession, path: str) -> str:
    fs, target = _at(spark, path)
    read = fs.open(target)
    found = spark.sparkContext._jvm.org.apache.commons.codec.digest.DigestUtils.sha256Hex(read)
    read.close()
    return found


def glob_pattern(glob: str) -> re.Pattern[str]:
    """What a glob means: ``**`` for any number of folders, ``*`` and ``?`` within a name, ``[...]``."""
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(?:[^/]+/)*", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        elif glob[i] == "[" and "]" in glob[i + 2 :]:
            end = glob.index("]", i + 2)
            body = glob[i + 1 : end].replace("\\", "\\\\")
            out, i = out + f"[{'^' + body[1:] if body.startswith('!') else body}]", end + 1
        else:
            out, i = out + {"*": "[^/]*", "?": "[^/]"}.get(glob[i], re.escape(glob[i])), i + 1
    return re.compile(out)


def expanded(spark: SparkSession, path: str) -> list[str]:
    """``path`` itself, or the files that a glob with ``**`` names, which Spark does not know."""
    if "**" not in path:
        return [path]
    fixed = re.match(r"[^*?\[]*", path)[0]  # up to the first sign of a glob
    root = fixed.rpartition("/")[0] or ("/" if fixed.startswith("/") else ".")
    fs, target = _at(spark, root)
    if not fs.exists(target):
        return []
    top, wanted, found = fs.getFileStatus(target).getPath().toUri().getPath(), glob_pattern(path), []
    files = fs.listFiles(target, True)
    while files.hasNext():
        full = files.next().getPath().toUri().getPath()
        own = root.rstrip("/") + full[len(top.rstrip("/")) :] if root != "." else full[len(top) + 1 :]
        if wanted.fullmatch(own):
            found.append(own)
    return sorted(found)
