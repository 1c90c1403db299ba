"""Rule tables of the known log formats: data, not code.

Rules are written with named groups. ``headers`` describe the line that starts an event (first match wins);
``body`` says what belongs to the message besides the header's own ``message`` group:

* ``all``  - every line up to the next header
* ``none`` - nothing, the message is what the header captured
* a regular expression - lines up to the first one it matches at the start
"""

from __future__ import annotations

from dataclasses import dataclass, field

from logweave.rules.levels import LEVEL_MAPPING


@dataclass(frozen=True)
class Extractor:
    """Named values to pull from a message: an anchor text and the expressions tried near it."""

    name: str
    anchor: str | None
    patterns: tuple[str, ...]


@dataclass(frozen=True)
class Origin:
    """Everything the engine knows about one log format."""

    name: str
    filenames: tuple[str, ...]
    headers: tuple[tuple[str, str], ...]
    ignore: tuple[str, ...] = ()
    extractors: tuple[Extractor, ...] = ()
    multiline: bool = True
    incremental: bool = False
    body: str = "all"
    profile: str = "baseline"
    timestamps: tuple[str, ...] = ()
    levels: dict[str, str] = field(default_factory=dict)
    default_component: str | None = None
    # (header, group) pairs whose name means something else than the record column of that name
    extra_only: tuple[tuple[str, str], ...] = ()


# --- Fixed values: ais ---------------------------------------------------------------------------------------------
AIS = Origin(
    name="ais",
    filenames=(r"^ais_\d+", r"^ais[\._-]", r"^ais", r".*[_-]ais[_-].*"),
    timestamps=(
        r"\d{1,2}\s+(?:ene|feb|mar|abr|may|jun|jul|ago|sep|oct|nov|dic)\s+\d{4}\s+\d{2}:\d{2}:\d{2}[,.]\d{3}",
        r"\d{1,2}\s+(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)\s+\d{4}\s+\d{2}:\d{2}:\d{2}[,.]\d{3}",
    ),
    headers=(
        (
            "ais_event",
            r"(?P<timestamp>\d{1,2}\s+\w+\s+\d{4}\s+\d{2}:\d{2}:\d{2}[,.]\d{3})\s+\[(?P<level>\w+)\s*\]\s+(?:(?P<user>[^\s\-\[]+)\s+)?-\s+\[(?P<component>CUSTOM|AIS)\](?:\s+|$)(?:\d{1,2}\s+\w+\s+\d{4}\s+\d{2}:\d{2}:\d{2}[,.]\d{3}\s+\[\w+\s*\]\s+\w+\s+-\s+\[\w+\](?:\s+|$))?",
        ),
    ),
    extractors=(
        Extractor(
            "job_number",
            "Job",
            (
                r"['\"]?jobNumber['\"]?\s*[:=]\s*['\"]?(?P<job_num>\d+)",
                r'(?:Job:\s*"|longEndPoint\s+)(?P<job_num>ORCH_[A-Za-z0-9_-]+)',
            ),
        ),
        Extractor("ais_parameter", "AIS", (r"AIS\s*Parameter\s*Not\s*Found\s*(\w*)$",)),
        Extractor(
            "business_module",
            "[",
            (
                r"\[(?P<business_module>GLS|JDE|ERP|CUSTOM|BSSV)\]",
                r"Module:\s*(?P<business_module>GLS|JDE|ERP|CUSTOM)",
            ),
        ),
        Extractor(
            "error_message",
            "errorMessage",
            (
                r"<errorMessage>(?P<error_message>[^<]+)</errorMessage>",
                r"Error:\s*(?P<error_message>[^\n]+)",
                r"ERROR\s*[-:]\s*(?P<error_message>[^\n]+)",
            ),
        ),
        Extractor(
            "warning_message",
            "warningMessage",
            (
                r"<warningMessage>(?P<warning_message>[^<]+)</warningMessage>",
                r"WARN:\s*(?P<warning_message>[^\n]+)",
            ),
        ),
        Extractor("orch_step_type", "Step", (r"Orchestration Step:\s*(?P<orch_step_type>[^:]+):",)),
        Extractor("orch_step_name", "Step", (r"Orchestration Step:\s*[^:]+:\s*(?P<orchestration_name>.+)",)),
    ),
    ignore=(
        r"Entrada:.*",
        r"fechaFormateada.*",
        r"AIS Version:.*",
        r"OrchScriptEngineManager",
        r"Session Manager Instance",
        r"RequestMonitorManager",
        r"Session.*START.*",
        r".*AIS Server Startup.*",
        r"SYNC SERVER.*",
    ),
    levels=LEVEL_MAPPING,
)

# --- Fixed values: alert_jde ---------------------------------------------------------------------------------------
ALERT_JDE = Origin(
    name="alert_jde",
    incremental=True,
    filenames=(r"alert_jde",),
    timestamps=(
        r"^(?P<year>\d{4})-(?P<month>\d{2})-(?P<day>\d{2})T(?P<hour>\d{2}):(?P<minute>\d{2}):(?P<second>\d{2})"
        r"\.(?P<microseconds>\d+)(?P<tz>[+-]\d{2}:\d{2})",
    ),
    headers=(("alert_jde_event", r"^(?P<timestamp>\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d+[+-]\d{2}:\d{2})\s*$"),),
    body=r"\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d+[+-]\d{2}:\d{2}",
    extractors=(
        Extractor("ora_error_code", "ORA-", (r"(?P<ora_error_code>ORA-\d+)",)),
        Extractor("tns_error_code", "TNS-", (r"(?P<tns_error_code>TNS-\d+)",)),
        Extractor("trace_file", "Errors in file", (r"Errors in file (?P<trace_file>[^\s:]+)",)),
        Extractor("db_username", "Current username=", (r"Current username=(?P<db_username>\S+)",)),
    ),
    ignore=(
        r".*Dumping current patch information.*",
        r"Shared IO Pool defaulting.*",
        r"\s*\*{4,}.*?Dump of system resources.*?(?=^\s*\*{4,})",
        r"Patch Id:\s*\d+\s*$",
        r"Patch Description:.*$",
        r"Patch Apply Time:.*$",
        r"Bugs Fixed:.*$",
        r"^[\d,\s]+$",
        r"^[=\*\-]+$",
        r"VERSION INFORMATION",
        r"TNS for Linux:",
        r"Oracle Bequeath NT Protocol Adapter for Linux:",
        r"TCP/IP NT Protocol Adapter for Linux:",
        r"Version \d+\.\d+\.\d+\.\d+\.\d+.*$",
        r"Tracing not turned on",
        r"Additional information:",
        r"(?:XDB initialized\.)",
        r"Thread.*log\s*sequence\s*",
        r"Thread.*allocate.*log",
        r".*crash.*thread.*",
        r"Resize operation completed",
        r"Per\s*process.*",
        r".*pagesize.*",
        r".*PAGESIZE.*",
        r"4K.*",
        r".*Dynamic\s*allocate.*",
        r".*pga_aggregate_limit.*",
        r"QPI.*",
        r"VKTM.*ms",
        r"Started\s*redo.*",
        r".*background process.*",
        r"An\s*internal\s*routine.*",
        r"Current\s*log.*",
        r"Starting.*instance.*",
        r"(?:Started|Completed)\s*redo\s*(?:scan|application)",
        r".*Checkpoint\s*not\s*complete.*",
        r".*XDB\s*installed.*",
        r".*GAP.*starting",
        r"Starting\s*up.*",
        r"Starting\s*background.*",
    ),
)

# --- Fixed values: bssv --------------------------------------------------------------------------------------------
BSSV = Origin(
    name="bssv",
    profile="strict_deep",
    filenames=(r"^bssv_\d+", r"bssv[\._-]", r"bssv\.log$", r".*_bssv_.*"),
    timestamps=(
        r"^\d{2}\s+(?:ene|feb|mar|abr|may|jun|jul|ago|sep|oct|nov|dic)\s+\d{4}\s+\d{2}:\d{2}:\d{2},\d{3}\s*",
        r"^\d{2}\s+(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)\s+\d{4}\s+\d{2}:\d{2}:\d{2},\d{3}\s*",
    ),
    headers=(
        (
            "bssv",
            r"(?P<timestamp>\d{2}\s+\w+\s+\d{4}\s+\d{2}:\d{2}:\d{2},\d{3})\s+\[(?P<level>\w+)\s*\]\s+-\s+"
            r"\[(?P<component>BSSVFRAMEWORK)\]\s+\[Context ID:\s+(?P<context_id>[^\]]+)\]\s+"
            r"\[(?P<client>[A-Za-z0-9_]+)\]\[(?P<pid>[A-Za-z0-9_]+)\]\s+(?P<message>.*)",
        ),
    ),
    body="none",
    ignore=(
        r"={5,}\s*$",
        r"-{5,}\s*$",
        r"Content-",
        r"<(?:/?soap:|/?env:|/?S:)",
        r"------=_Part_",
        r"Recuperamos\s*credenciales",
        r"^endobj\s*$",
        r"^stream\s*$",
        r"^endstream\s*$",
        r"^\d+\s+\d+\s+f\s*$",
        r"^xref\s*$",
        r"^trailer\s*$",
        r"^startxref\s*$",
        r"^%%EOF\s*$",
        r"^\d+\s+0\s+obj\s*$",
        r"^/Type\s+/Font",
        r"^/Type\s+/Page",
        r"^/Type\s+/Catalog",
        r"^/Type\s+/Filespec",
        r"^/Length\s+\d+",
        r"^/Filter\s+/",
        r"^/ProcSet\s+",
        r"^/BaseFont\s+/",
        r"^/Subtype\s+/Image",
        r"^/Width\s+\d+",
        r"^/Height\s+\d+",
        r"^/ColorSpace\s+/",
        r"^/BitsPerComponent\s+\d+",
        r"^\d+\s+\d+\s+R\s*$",
        r"^%PDF-",
        "^%\ufffd\ufffd\ufffd\ufffd",
        r"![$]7MX",
        r"![.%]gX",
        r"!fAD!!fAD",
        r"!!2\s*\?!!2",
        r"!;[*]Y\s+!;[*]Y",
        r"!'N%[+]!'N%",
        r"!-ig!!-ig",
        r"!\\.&\s+S!\\.&\s+S",
        r"^[!@#$%^&*]{10,}",
        r"^[A-Za-z0-9+/]{100,}$",
        r"^[0-9a-fA-F\s]{100,}$",
        r"rrr[A-Z][a-z]{3,}",
        r"ValueObject.*NULL.*NULL.*NULL",
        r"Update\s+Pkg.*Built.*Deployed.*Detected",
    ),
)

# --- Fixed values: e1root ------------------------------------------------------------------------------------------
E1ROOT = Origin(
    name="e1root",
    filenames=(r"^e1root_.*", r"^.*_html_log.*", r"^.*_e1root_.*", r"^jderoot_\d+", r"^.*_jderoot_.*"),
    timestamps=(
        r"\d{1,2}\s+(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)\s+\d{4}\s+\d{2}:\d{2}:\d{2}[,.]\d{3}",
        r"\d{1,2}\s+(?:ene|feb|mar|abr|may|jun|jul|ago|sep|oct|nov|dic)\s+\d{4}\s+\d{2}:\d{2}:\d{2}[,.]\d{3}",
    ),
    headers=(
        (
            "e1root_with_user",
            r"(?P<timestamp>\d{2}\s+\w+\s+\d{4}\s+\d{2}:\d{2}:\d{2},\d{3})\s+\[(?P<level>\w+)\s*\]\s+(?P<user>[A-Z0-9_-]+)\s+-\s+\[(?P<component>[^\]]+)\]\s*(?P<message>.*)",
        ),
        (
            "e1root_with_pid",
            r"(?P<timestamp>\d{2}\s+\w+\s+\d{4}\s+\d{2}:\d{2}:\d{2},\d{3})\s+\[(?P<level>\w+)\s*\]\s+-\s+\[(?P<process_id>\d+)\]\[(?P<component>[^\]]+)\]\s*(?P<message>.*)",
        ),
        ("e1root_simple", r"(?P<timestamp>\d{2}\s+\w+\s+\d{4}\s+\d{2}:\d{2}:\d{2},\d{3})\s+\[(?P<level>\w+)\s*\]\s*-\s+\[(?P<component>[^\]]+)\]\s*(?P<message>.*)"),
    ),
    body="none",
    extractors=(
        Extractor("user", "User", (r"user:+(?P<username>[A-Z0-9_-]+)",)),
        Extractor(
            "service_name",
            "Service",
            (
                r"Service[:\s]+(?P<service_name>[\w.-]+)",
                r"Starting service\s+(?P<service_name>[\w.-]+)",
                r"Stopping service\s+(?P<service_name>[\w.-]+)",
            ),
        ),
        Extractor(
            "error_code",
            "Error",
            (
                r"Error[:\s]+(?P<error_code>\d+)",
                r"ErrorCode[:\s]+(?P<error_code>\d+)",
                r"Error\s+Code[:\s]+(?P<error_code>\d+)",
            ),
        ),
        Extractor(
            "exception_type",
            "Exception",
            (
                r"com\.(?!jdedwards\.database\.base\.JDBException\b)(?P<exception_type>[\w.]+Exception)",
                r"Exception Type[:\s]+(?P<exception_type>[\w.]+)",
            ),
        ),
        Extractor("db_exception_type", "database.base.JDBException", (r"\[(?P<exception_type>[A-Z0-9_]+)\]",)),
        Extractor(
            "jde_table",
            "F",
            (
                r"Table[:\s]+(?P<jde_table>F\d{2,6}[\w]*)",
                r"FROM\s+(?P<jde_table>F\d{2,6}[\w]*)",
                r"INTO\s+(?P<jde_table>F\d{2,6}[\w]*)",
                r"\[(?P<jde_table>F\d{2,6}[\w]*)\]",
            ),
        ),
        Extractor("sql_statement_type", "SQL", (r"(?P<sql_statement_type>SELECT|INSERT|UPDATE|DELETE|MERGE)\s+",)),
    ),
    ignore=(
        r"[=\*\-]{5,}\s*",
        r"clean up thread",
        r"cleanup thread",
        r"thread pool.*cleanup",
        r"RtfTemplate\.generateReport",
        r"Translation is null for",
        r"getCachedObject.*cache hit",
        r"getCachedObject.*cache miss",
        r"^\[INFO\s*\].*-\s*\[RUNTIME\].*starting thread",
        r"^\[INFO\s*\].*-\s*\[RUNTIME\].*stoping thread",
        r"^\[INFO\s*\].*-\s*\[RUNTIME\].*stopped thread",
        r"Entering method",
        r"Exiting method",
        r"Method entry:",
        r"Method exit:",
        r"Health check.*OK",
        r"Heartbeat received",
        r"Keep-alive.*sent",
        r"Session.*created\s*$",
        r"Session.*destroyed\s*$",
        r"Cache entry added",
        r"Cache entry removed",
        r"Cache entry expired",
        r"Configuration parameter:.*=",
        r"System property:.*=",
        r"Previous\s*serialized\s*objects",
        r"(?:Discovered|Discovery)",
        r"Manifest",
        r"Package:",
        r"Update\s*Pkg",
        r".*package.*discovery.*",
        r".*serialized\s*object.*",
        r".*EnterpriseOne.*",
    ),
    levels=LEVEL_MAPPING,
)

# --- Fixed values: jas ---------------------------------------------------------------------------------------------
JAS = Origin(
    name="jas",
    multiline=False,
    profile="very_strict",
    filenames=(r"^jas_\d+", r".*_jas_.*"),
    timestamps=(
        r"(?P<day>\d{2})\s+(?P<month_name>\w{3})\s+(?P<year>\d{4})\s+(?P<hour>\d{2}):(?P<minute>\d{2}):"
        r"(?P<second>\d{2}),(?P<milliseconds>\d{3})",
    ),
    headers=(
        (
            "jas",
            r"^(?P<timestamp>\d{1,2}\s+\w{3}\s+\d{4}\s+\d{2}:\d{2}:\d{2},\d{3})\s+\[(?P<level>\w+)\s*\]\s*-\s*"
            r"\[(?P<pid>\d+)\]\[(?P<component>\w+)\]\s*(?P<message>[^\n\r]+)",
        ),
    ),
    body="none",
    extractors=(
        Extractor(
            "exception_type",
            "Exception",
            (
                r"(?P<exception_type>com\.jdedwards\.xmlp\.exceptions\.[\w]+Exception)",
                r"(?P<exception_type>oracle\.xdo\.[\w.]+Exception)",
                r"(?P<exception_type>java\.[\w.]+Exception)",
            ),
        ),
        Extractor(
            "error_message",
            "failed",
            (
                r"(?P<error_message>Excel Processor failed)",
                r"(?P<error_message>PDF Processor failed)",
                r"(?P<error_message>Report generation failed)",
                r"(?P<error_message>Email delivery failed)",
                r"(?P<error_message>Fax delivery failed)",
            ),
        ),
        Extractor(
            "username",
            "User",
            (
                r"User[:\s]+(?P<username>[A-Z0-9_-]+)",
                r"UserID[:\s]+(?P<username>[A-Z0-9_-]+)",
                r"Submitted by[:\s]+(?P<username>[A-Z0-9_-]+)",
            ),
        ),
        Extractor("job_number", "Job", (r"Job[:\s]+(?P<job_number>\d+)", r"JobID[:\s]+(?P<job_number>\d+)")),
        Extractor("data_source", "Data Source", (r"Data Source[:\s]+(?P<data_source>[\w_-]+)",)),
        Extractor("connection_string", "Connection", (r"Connection[:\s]+(?P<connection_string>jdbc:[\w:/.-]+)",)),
    ),
    ignore=(
        r"^\s*$",
        r"[=\*\-]{5,}\s*",
        r".*Translation is null\.\s+Continuing",
        r".*Thread pool.*cleanup",
        r".*clean up thread",
        r".*begin report generation",
        r".*report generation completed",
        r".*RtfTemplate\.generateReport\(\)",
        r".*Cache.*hit\s*$",
        r".*Cache.*miss\s*$",
        r".*Heartbeat.*OK",
        r".*Keep-alive sent",
    ),
)

# --- Fixed values: jde ---------------------------------------------------------------------------------------------
JDE = Origin(
    name="jde",
    filenames=(r"^jde_\d+", r"^.*enterprise.*", r"^.*_jde_\d+"),
    timestamps=(
        r"(?P<day_name>\w{3})\s+(?P<month_name>\w{3})\s+(?P<day>\d{1,2})\s+(?P<hour>\d{2}):(?P<minute>\d{2}):"
        r"(?P<second>\d{2})\.(?P<microseconds>\d{6})",
    ),
    headers=(
        (
            "jde",
            r"^(?P<pid>\d+)(?:/\d+)?[ \t]+(?:[^\t\n]*)\t(?P<timestamp>\w{3}\s+\w{3}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2}\.\d{6})\t(?P<component>\S+)\s*$",
        ),
    ),
    body=r"\d+(?:/\d+)?[ \t]+[^\t\n]*\t\w{3}\s+\w{3}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2}\.\d{6}",
    extractors=(
        Extractor("oracle_error_code", "ORA-", (r"ORA-(?P<oracle_error_code>\d{5})",)),
        Extractor("jde_error_code", "JDB", (r"(?P<jde_error_code>JDB\d{7})",)),
    ),
    ignore=(
        r"^\s*$",
        r"^[=\*\-]{5,}\s*$",
        r"clean up",
        r"No email address found ",
        r"Print request failed",
        r"Translation is null",
        r"RtfTemplate",
        r"This is Small Job kernel\s*",
        r"Attempting.*printer.*",
        r"Enterprise.*One.*",
        r"Active.*Kernel.*",
        r".*registered.*entry.*",
        r"KERNEL\s*RECYCLING",
        r"Starting.*KERNEL.*",
        r"INITIALIZING.*KERNEL.*",
        r"ICU.*, ",
        r".*dispatchKernelQueueMsg.*",
        r"VERSION INFORMATION",
        r"TNS for Linux:",
        r"Oracle Bequeath NT Protocol Adapter for Linux:",
        r"TCP/IP NT Protocol Adapter for Linux:",
        r"Version \d+\.\d+\.\d+\.\d+\.\d+.*$",
        r"Tracing not turned on",
        r"Additional information:",
        r"(?:XDB initialized\.)",
        r"Thread.*log\s*sequence\s*",
        r"Thread.*allocate.*log",
        r"Initializing.*",
        r"Terminating.*",
        r"(?:Getting)?.*(?:U|u)ser.*data.*",
        r".*RUNBATCH.*",
        r"Default\s*output.*",
        r"Startup\s*for\s*User.*",
        r".*XML\s*Session.*",
        r".*Scheduler.*",
        r"Cleaning.*",
    ),
)

# --- Fixed values: jdedebug ----------------------------------------------------------------------------------------
JDEDEBUG = Origin(
    name="jdedebug",
    filenames=(r"^jdedebug_\d+", r"jdedebug[\._-]", r"jdedebug\.log$", r".*_jdedebug_.*"),
    timestamps=(
        r"^(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)\s*\d{1,2}\s*\d{2}:\d{2}:\d{2}\.\d{6}\s*",
    ),
    headers=(
        ("jdedebug_timestamp_only", r"^(?P<timestamp>(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)\s{1,2}\d{1,2}\s+\d{2}:\d{2}:\d{2}\.\d{6})$"),
        (
            "jdedebug_tab_separated_extra",
            r"^(?P<timestamp>(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)\s{1,2}\d{1,2}\s+\d{2}:\d{2}:\d{2}\.\d{6})\s*\t\s*(?P<component>\S+(?:\s+\S+)?)\s*\t\s*-\s*[\t\s]*(?P<message>.+)$",
        ),
        ("jdedebug_pid_tid", r"^(?P<timestamp>(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)\s{1,2}\d{1,2}\s+\d{2}:\d{2}:\d{2}\.\d{6})\s+-\s+(?P<pid>\d+)/(\d+)\s+(?P<component>\S+)\s+(?P<message>.+)$"),
        (
            "jdedebug_tab_separated",
            r"^(?P<timestamp>(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)\s{1,2}\d{1,2}\s+\d{2}:\d{2}:\d{2}\.\d{6})\s*\t\s*(?P<component>\S+(?:\s+\S+)?)\s*\t\s*-\s+(?P<message>.+)$",
        ),
        ("jdedebug_file_line", r"^(?P<timestamp>(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)\s{1,2}\d{1,2}\s+\d{2}:\d{2}:\d{2}\.\d{6})\s*\t(?P<source_file>\S+)\s*\t\s*-\s+(?P<message>.+)$"),
        (
            "jdedebug_metadata",
            r"^(?P<key>PID/PSThread_ID|System Thread ID|Thread Name|CALLSTACK):\s*(?P<value>.*)$",
        ),
        (
            "jdedebug_callstack_header",
            r"^(?P<header>Level\s+Program\s+Library\s+Module\s+Statement\s+Procedure)$",
        ),
        (
            "jdedebug_stack_frame",
            r"^(?P<level>\d+)\s+(?P<program>\S+)\s+(?P<library>\S+)\s+(?P<module>\S+)\s+(?P<statement>\S+)"
            r"(?:\s+(?P<procedure>.+))?$",
        ),
        ("jdedebug_continuation", r"^(?P<message>.+)$"),
    ),
    body="none",
    extra_only=(("jdedebug_stack_frame", "level"),),
    extractors=(
        Extractor("error_code", "Error", (r"Error\s+(?P<error_code>\d{4})",)),
        Extractor(
            "error_source_file", ".c", (r"(?P<error_source_file>[\w_]+\.c)\s+Line\s+(?P<error_line>\d+)",)
        ),
        Extractor("operation_failed", "failed", (r"(?P<operation_failed>[\w\s]+)\s+failed",)),
        Extractor("username", "WRK:", (r"WRK:(?P<username>[A-Z][A-Z0-9]+)_",)),
        Extractor(
            "jde_application",
            "_",
            (
                r"WRK:[A-Z0-9]+_[A-F0-9]+_(?P<jde_application>[PRP]\d{5,8})",
                r"Application\s+Name.*?\[(?P<jde_application>[PRP]\d{5,8})\]",
            ),
        ),
        Extractor(
            "jde_table",
            "FROM",
            (r"FROM\s+[\w.]+\.(?P<jde_table>F\d{2,6}[\w]*)", r"Table[:\s]+(?P<jde_table>F\d{2,6}[\w]*)"),
        ),
        Extractor("sql_statement_type", "SELECT", (r"(?P<sql_statement_type>SELECT|INSERT|UPDATE|DELETE)\s+",)),
    ),
    ignore=(r"^\s*$", r"^[=\*\-]{5,}\s*$", r".*jdeDebugInit.*", r".*DEBUG\s*INIT.*"),
)

# --- Fixed values: listener ----------------------------------------------------------------------------------------
LISTENER = Origin(
    name="listener",
    incremental=True,
    profile="deep",
    filenames=(r"^listener_\d+", r"^listener.*", r"^.*_listener_.*"),
    timestamps=(
        r"(?P<day>\d{2})-(?P<month_name>\w{3})-(?P<year>\d{4})\s+(?P<hour>\d{2}):(?P<minute>\d{2}):(?P<second>\d{2})",
    ),
    headers=(
        (
            "db_listener_connection",
            r"^(?P<timestamp>\d{2}-\w{3}-\d{4}\s+\d{2}:\d{2}:\d{2})\s*(?P<message>.+)$",
        ),
    ),
    body="none",
    extractors=(
        Extractor("service_name", "SERVICE_NAME", (r"SERVICE_NAME=(?P<service_name>[^\)]+)",)),
        Extractor("program", "PROGRAM", (r"PROGRAM=(?P<program>[^\)]+)",)),
        Extractor("host_name", "CID", (r"CID=\([^)]*HOST=(?P<host_name>[^\)]+)",)),
        Extractor("host_ip", "PROTOCOL=tcp", (r"PROTOCOL=tcp\)\(HOST=(?P<host_ip>[^\)]+)",)),
        Extractor("port", "PROTOCOL=tcp", (r"PROTOCOL=tcp\)\(HOST=[^\)]+\)\(PORT=(?P<port>\d+)",)),
        Extractor("tns_error_code", "TNS-", (r"TNS-(?P<tns_error_code>\d{5})",)),
        Extractor(
            "linux_error_code",
            "Linux Error:",
            (r"Linux Error:\s+(?P<linux_error_code>\d+):\s+(?P<linux_error_message>[^\n]+)",),
        ),
    ),
    ignore=(
        r"^\s*$",
        r".*\* establish \* jde \* 0$",
        r".*\* handoff \* http \* 0$",
        r".*\* service_update \* jde \* 0$",
        r".*\* service_register \* jde \* 0$",
        r".*\* status \* 0$",
        r".*\* ping \* 0$",
        r".*\* version \* 1189$",
        r"LISTENER for Linux: Version",
        r"Version \d+\.\d+\.\d+\.\d+",
        r"System parameter file is",
        r"Log messages written to",
        r"Trace information written to",
        r"Trace level is currently",
        r"Started with pid=",
        r"Listening on:",
        r"Listener completed notification to CRS",
        r"TIMESTAMP \* CONNECT DATA",
        r"WARNING: Subscription for node down event",
        r"Dynamic address is already listened on",
        r"Creating new log segment:",
    ),
)

# --- Fixed values: weblogic ----------------------------------------------------------------------------------------
WEBLOGIC = Origin(
    name="weblogic",
    profile="deep",
    filenames=(r"^weblogic_\d+", r"weblogic\.log$", r"^.*_weblogic_.*"),
    timestamps=(
        r"(?P<day>\d{2})\s+(?P<month_name>\w{3})\s+(?P<year>\d{4})\s+(?P<hour>\d{2}):(?P<minute>\d{2}):"
        r"(?P<second>\d{2}),(?P<milliseconds>\d{3})",
    ),
    headers=(
        (
            "weblogic",
            r"(?P<timestamp>\d{1,2}\s+\w{3}\s+\d{4}\s+\d{2}:\d{2}:\d{2},\d{3})\s+\[(?P<level>[A-Z]+)\]\s*"
            r"(?:(?P<user>[A-Za-z0-9_\-]+)\s+-\s+|\s*-\s+)\[(?P<app>[^\]]+)\]\[(?P<component>[^\]]+)\]\s*"
            r"(?P<message>[^\n\r]*)",
        ),
    ),
    body=r"\d{1,2}\s+\w{3}\s+\d{4}",
    extractors=(
        Extractor("oracle_error_code", "ORA-", (r"ORA-(?P<oracle_error_code>\d{5})",)),
        Extractor("jde_error_code", "JDB", (r"(?P<jde_error_code>JDB\w+)",)),
        Extractor(
            "username",
            "UserName",
            (
                r"UserName[:\s]+(?P<username>[A-Z0-9_-]+)",
                r"\[WARN\s*\]\s+(?P<username>[A-Z]+)\s+-\s+",
                r"\[SEVERE\]\s+(?P<username>[A-Z]+)\s+-\s+",
                r"user[:\s]+(?P<username>[A-Z][A-Z0-9]+)",
            ),
        ),
        Extractor(
            "jde_application",
            "App Name",
            (
                r"App Name[:\s]+(?P<jde_application>P\d{5,8}_W\d{5,8}[A-Z]?_[A-Z0-9]+)",
                r"Form Name[:\s]+(?P<jde_application>P\d{5,8}_W\d{5,8}[A-Z]?)",
            ),
        ),
        Extractor("report_name", "Report Name", (r"Report Name[:\s]+(?P<report_name>R\d{5,8}_?)",)),
        Extractor(
            "jde_table",
            "Table",
            (
                r"Table[:\s]+(?P<jde_table>F\d{2,6}[\w]*)",
                r"Table or View Name[:\s]+(?P<jde_table>F\d{2,6}[\w]*)",
                r"for table\s+(?P<jde_table>F\d{2,6}[\w]*)",
            ),
        ),
        Extractor(
            "exception_type",
            "Exception",
            (
                r"(?P<exception_type>com\.jdedwards\.[\w.]+Exception)",
                r"(?P<exception_type>java\.[\w.]+Exception)",
                r"(?P<exception_type>oracle\.[\w.]+Exception)",
            ),
        ),
        Extractor(
            "operation_failed",
            "failed",
            (
                r"(?P<operation_failed>[\w\s]+)\s+failed",
                r"Failed to\s+(?P<operation_failed>[\w\s]+)",
                r"Unable to\s+(?P<operation_failed>[\w\s]+)",
            ),
        ),
    ),
    ignore=(
        r"^\s*$",
        r".*Update:\s+Update\s+Pkg\s+=.*Built\s+=.*Deployed\s+=.*Detected\s+=",
        r".*Initiating EnterpriseOne startup",
        r".*Successfully initialized the EnterpriseOne web engine",
        r".*Centralized Configuration is disabled",
        r".*This server is using Automatic Package discovery",
        r".*serialized object database will be maintained",
        r".*Serialized objects have been found up to date",
        r".*Discovery.*system is now in sync with the deployed package",
        r".*Discovered enterprise server on host",
        r".*Discovered package.*in Central Objects",
    ),
)

# Detection order: a longer name is more specific, so it is tried first; ties go alphabetically.
ORIGINS: tuple[Origin, ...] = tuple(
    sorted(
        (AIS, ALERT_JDE, BSSV, E1ROOT, JAS, JDE, JDEDEBUG, LISTENER, WEBLOGIC),
        key=lambda origin: (-len(origin.name), origin.name),
    )
)
BY_NAME: dict[str, Origin] = {origin.name: origin for origin in ORIGINS}
