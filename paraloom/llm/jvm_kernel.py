"""JVM functions whose Java source lies in this package, compiled when first used.

The compiler is the one that Spark itself ships for generated code, so nothing is
installed; the classes and the data they read go to the executors as jars that
they fetch from the driver.
"""

from __future__ import annotations

import os
import tempfile
import zipfile
from importlib import resources

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def _add_jar(spark: SparkSession, name: str, files: dict[str, bytes]) -> None:
    path = os.path.join(tempfile.mkdtemp(prefix="paraloom"), f"{name}.jar")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as jar:
        for file, content in files.items():
            jar.writestr(file, content)
    spark.sql(f"ADD JAR '{path}'")


def _once(spark: SparkSession, name: str, files) -> None:
    """Add the jar name with what files() gives, if this application does not have it yet."""
    system, key = spark.sparkContext._jvm.java.lang.System, f"paraloom.jar.{name}.{spark.sparkContext.applicationId}"
    if not system.getProperty(key):
        _add_jar(spark, name, files())
        system.setProperty(key, name)


def call(spark: SparkSession, class_name: str, source: str, method: str, *arguments: Column, data: dict[str, bytes] | None = None) -> Column:
    """A static Java method of the class in the package's file source, on columns of strings and numbers; it returns a string.

    data: files by name that the class finds as resources.
    """

    def compiled() -> dict[str, bytes]:
        compiler = spark.sparkContext._jvm.org.codehaus.janino.SimpleCompiler()
        compiler.cook(resources.files(__package__).joinpath(source).read_text())
        return {f"{e.getKey().replace('.', '/')}.class": bytes(e.getValue()) for e in compiler.getBytecodes().entrySet()}

    for name, content in (data or {}).items():
        _once(spark, name, lambda name=name, content=content: {name: content})
    _once(spark, class_name, compiled)
    return F.reflect(F.lit(class_name), F.lit(method), *arguments)
