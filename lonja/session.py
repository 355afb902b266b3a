"""Session settings, the shared folder for cut lineage, and table loading."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

_SHARED: dict[str, str] = {}
_SHIPPED: set[str] = set()
_JAVA: dict[tuple[str, str], object] = {}


def shared_folder(spark: SparkSession) -> str:
    """A folder of this session inside the cluster's `spark.checkpoint.dir`.

    The setting is read from the session. Only where it is unset and the executors are this
    machine's own threads (tests) a temporary folder takes its place; on a cluster each machine
    would write to its own disk and read back a part, so there it is an error. The folder is
    removed when the driver ends.
    """
    app = spark.sparkContext.applicationId
    if app not in _SHARED:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            master = spark.sparkContext.master
            if not re.fullmatch(r"local(\[.*\])?", master):
                raise ValueError(f"spark.checkpoint.dir must name a folder that all machines of {master} share")
            base = "file://" + tempfile.mkdtemp(prefix="lonja-")
        _SHARED[app] = f"{base.rstrip('/')}/lonja-{uuid.uuid4().hex}"
        atexit.register(_remove, spark, _SHARED[app])
    return _SHARED[app]


def _remove(spark: SparkSession, folder: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # the JVM has ended already
        pass


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once for each application, wherever they were started."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    _SHIPPED.add(context.applicationId)
    package = Path(__file__).parent
    # The driver serves the archive from its own disk, as long as the application runs.
    folder = tempfile.mkdtemp(prefix="lonja-code-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = Path(folder, f"{package.name}.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    context.addPyFile(str(archive))


def java_function(spark: SparkSession, name: str, kind: str, source: Path, returns: str) -> bool:
    """Make the class `kind` of a Java source, a UDF1, the session's SQL function `name`; false where it can't be compiled.

    Janino, which Spark compiles its own plans with, compiles it once for each application, and executors get it as a jar.
    """
    context, jvm = spark.sparkContext, spark._jvm
    key = (context.applicationId, kind)
    if key not in _JAVA:
        compiler = jvm.org.codehaus.janino.SimpleCompiler()
        try:
            compiler.cook(source.read_text())
            none = context._gateway.new_array
            made = compiler.getClassLoader().loadClass(kind).getDeclaredConstructor(none(jvm.java.lang.Class, 0)).newInstance(none(jvm.java.lang.Object, 0))
        except Py4JJavaError:  # this JVM lacks a module that the source names
            made = None
        if made is not None:
            folder = tempfile.mkdtemp(prefix="lonja-java-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
            jar = Path(folder, f"{name}.jar")
            with zipfile.ZipFile(jar, "w") as z:
                for k, code in compiler.getBytecodes().items():
                    z.writestr(f"{k.replace('.', '/')}.class", bytes(code))
            context._jsc.addJar(str(jar))
        _JAVA[key] = made
    if _JAVA[key] is None:
        return False
    session = spark._jsparkSession
    session.udf().register(name, _JAVA[key], jvm.org.apache.spark.sql.types.DataType.fromDDL(returns))
    return True


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage of `df`: write it to the shared folder and read it back.

    Every executor can read the table, so a later loss of an executor costs nothing.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the project's parquet tables."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
