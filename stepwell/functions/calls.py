"""Columns over logs of remote calls: statuses, results, attempts, and the fields derived from others."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Status by HTTP code where the hundreds don't decide.
BY_CODE = {401: "access_denied", 402: "access_denied", 403: "access_denied", 404: "success", 405: "bad_request", 406: "bad_request", 407: "access_denied", 408: "timeout", 429: "throttled", 503: "unavailable", 511: "access_denied"}
#: Status by exception class, of which the first that is in the class chain counts.
BY_EXCEPTION = (("SSLException", "access_denied"), ("SocketTimeoutException", "timeout"), ("TimeoutException", "timeout"), ("IOException", "connection_error"), ("IllegalArgumentException", "bad_request"), ("IllegalStateException", "bad_request"))
#: Subclasses in the JDK of those classes.
SUBCLASSES = {
    "SSLException": "SSLHandshakeException SSLKeyException SSLPeerUnverifiedException SSLProtocolException",
    "IOException": "AccessDeniedException AsynchronousCloseException AtomicMoveNotSupportedException BindException ChangedCharSetException CharacterCodingException CharConversionException ClosedByInterruptException ClosedChannelException ConnectException DirectoryNotEmptyException EOFException FileAlreadyExistsException FileLockInterruptionException FileNotFoundException FileSystemException FileSystemLoopException HttpConnectTimeoutException HttpRetryException HttpTimeoutException IIOException InterruptedByTimeoutException InterruptedIOException InvalidClassException InvalidObjectException InvalidPropertiesFormatException JarException JMXProviderException JMXServerErrorException MalformedInputException MalformedURLException NoRouteToHostException NoSuchFileException NotActiveException NotDirectoryException NotLinkException NotSerializableException ObjectStreamException OptionalDataException PortUnreachableException ProtocolException RemoteException SaslException SocketException StreamCorruptedException SyncFailedException UTFDataFormatException UnknownHostException UnknownServiceException UnmappableCharacterException UnsupportedEncodingException WebSocketHandshakeException WriteAbortedException ZipException",
    "IllegalArgumentException": "IllegalChannelGroupException IllegalCharsetNameException IllegalFormatException IllegalSelectorException IllegalThreadStateException InvalidKeyException InvalidParameterException InvalidPathException NumberFormatException PatternSyntaxException ProviderMismatchException UnresolvedAddressException UnsupportedAddressTypeException UnsupportedCharsetException",
    "IllegalStateException": "AcceptPendingException AlreadyBoundException AlreadyConnectedException CancellationException CancelledKeyException ClosedDirectoryStreamException ClosedFileSystemException ClosedSelectorException ClosedWatchServiceException ConnectionPendingException FormatterClosedException IllegalBlockingModeException InvalidMarkException NoConnectionPendingException NonReadableChannelException NonWritableChannelException NotYetBoundException NotYetConnectedException OverlappingFileLockException ReadPendingException ShutdownChannelGroupException WritePendingException",
}
STATUSES = ("success", "bad_request", "unexpected_error", "connection_error", "unavailable", "throttled", "timeout", "cancelled", "access_denied", "application_error")

def status_of_code(code: Column, standard: bool = False) -> Column:
    """Status of an HTTP code; 503 counts as throttled unless ``standard``."""
    table = BY_CODE if standard else BY_CODE | {503: "throttled"}
    out = None
    for status in dict.fromkeys(table.values()):
        hit = code.isin(*[c for c, s in table.items() if s == status])
        out = F.when(hit, status) if out is None else out.when(hit, status)
    return out.when(code < 100, "unexpected_error").when(code < 400, "success").when(code < 500, "bad_request").when(code.isNotNull(), "unexpected_error")


def simple_name(name: Column) -> Column:
    return F.element_at(F.split(name, r"[.$]"), -1)


def status_of_exception(name: Column, chain: Column | None = None) -> Column:
    """Status of an exception by its class, also where that is a subclass of a known one.

    ``chain``: array of the names of its superclasses, for classes that aren't in the JDK.
    """
    simple, out = simple_name(name), None
    above = F.transform(F.coalesce(chain, F.array().cast("array<string>")), simple_name) if chain is not None else None
    for known, status in BY_EXCEPTION:
        names = [known, *SUBCLASSES.get(known, "").split()]
        hit = simple.isin(*names)
        if above is not None:
            hit = hit | F.arrays_overlap(above, F.array(*map(F.lit, names)))
        out = F.when(hit, status) if out is None else out.when(hit, status)
    return out.when(name.isNotNull(), "unexpected_error")


def result_of(status: Column) -> Column:
    return F.when(status == "success", "success").when(status.isNotNull(), "failure")


def attempt_of(number: Column) -> Column:
    """Attempts are counted from 1."""
    return F.when(number == 1, "initial").when(number == 2, "second").when(number >= 3, "third_up").otherwise("unknown")


def region_of(zone: Column) -> Column:
    """The zone without its last letter (``us-east-1a``: us-east-1), or without what follows its last dash (``us-east1-b``)."""
    return F.when(zone.rlike("[0-9][a-z]$"), F.regexp_replace(zone, "[a-z]$", "")).when(zone.rlike("-[a-z]$"), F.regexp_replace(zone, "-[a-z]$", ""))


def valid_code(code: Column) -> Column:
    return F.when((code >= 100) & (code < 600), code).otherwise(-1)


def derived(log: DataFrame) -> DataFrame:
    """A log (any of status, result, http_status, exception, http_method, asg, app, cluster, zone, region, attempt,
    endpoint, path) with the fields that follow from others filled in where they are null."""
    from .text import sanitize_path, server_group

    have = set(log.columns)
    col = lambda c, kind="string": F.col(c).cast(kind) if c in have else F.lit(None).cast(kind)
    code = valid_code(col("http_status", "int"))
    simple = simple_name(col("exception"))
    status = F.coalesce(col("status"), status_of_exception(col("exception")), F.when(code > 0, status_of_code(code)), F.lit("success"))
    group = server_group(col("asg"))
    return log.withColumns({
        "http_status": code, "status": status, "result": F.coalesce(col("result"), result_of(status)), "status_detail": F.coalesce(col("status_detail"), simple), "http_method": F.lower(F.coalesce(col("http_method"), F.lit("unknown"))),
        "app": F.coalesce(col("app"), group["app"]), "cluster": F.coalesce(col("cluster"), group["cluster"]), "region": F.coalesce(col("region"), region_of(col("zone"))), "attempt": attempt_of(F.coalesce(col("attempt", "int"), F.lit(1))), "endpoint": F.coalesce(col("endpoint"), F.when(code != 404, sanitize_path(col("path"))), F.lit("unknown")),
    })


def violations(log: DataFrame, required: tuple[str, ...] = ("result", "status", "endpoint")) -> DataFrame:
    """Rows with the rules they break: missing dimensions, unknown statuses, a result that its status contradicts."""
    checks = [F.when(F.col(c).isNull(), F.lit(f"missing {c}")) for c in required if c in log.columns]
    checks.append(F.when(~F.col("status").isin(*STATUSES), F.lit("unknown status")))
    checks.append(F.when(~F.col("result").isin("success", "failure"), F.lit("unknown result")))
    checks.append(F.when(result_of(F.col("status")) != F.col("result"), F.lit("result contradicts status")))
    return log.withColumn("violations", F.array_compact(F.array(*checks))).where(F.size("violations") > 0)
