"""Java functions of a row that come with this package as source.

A source is compiled once per application by the compiler that Spark itself uses for
its plans, and its classes go to the executors as an added jar, so nothing has to be
built or installed.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile
from importlib import resources

from pyspark.sql import SparkSession
from pyspark.sql.types import DataType

_LOADED: dict[tuple[str, str], object] = {}


def _loaded(spark: SparkSession, name: str):
    """The class ``lever.<name>`` on the driver, once its jar is added."""
    mark = (spark.sparkContext.applicationId, name)
    if mark not in _LOADED:
        jvm = spark.sparkContext._jvm
        compiler = jvm.org.codehaus.janino.SimpleCompiler()
        compiler.setParentClassLoader(jvm.java.lang.Thread.currentThread().getContextClassLoader())
        compiler.cook(resources.files(__package__).joinpath(f"{name}.java").read_text())
        folder = tempfile.mkdtemp(prefix="lever-jar-")
        atexit.register(shutil.rmtree, folder, True)
        path = os.path.join(folder, f"lever-{name}.jar")
        with zipfile.ZipFile(path, "w") as jar:
            for found in compiler.getBytecodes().entrySet():
                jar.writestr(found.getKey().replace(".", "/") + ".class", bytes(found.getValue()))
        spark.sparkContext._jsc.sc().addJar(path)
        _LOADED[mark] = compiler.getClassLoader().loadClass(f"lever.{name}")
    return _LOADED[mark]


def register(spark: SparkSession, source: str, name: str, returns: DataType, *options) -> str:
    """``name``, now that of the function ``lever.<source>`` with ``options``, for :func:`pyspark.sql.functions.call_udf`."""
    function = _loaded(spark, source).newInstance().set(*options)
    spark._jsparkSession.udf().register(name, function, spark._jsparkSession.parseDataType(returns.json()))
    return name
