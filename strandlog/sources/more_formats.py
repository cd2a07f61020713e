"""More of the format catalogue: regex formats of servers and libraries."""

from __future__ import annotations

from strandlog.sources.formats import WORDS, Format
from strandlog.sources.layouts import layout

_ISO = r"\d{4}-\d\d-\d\d[T ]\d\d:\d\d:\d\d"

MORE = (
    Format(
        "error_log",
        (
            r"^\[(?<timestamp>[A-Z][a-z]{2} [A-Z][a-z]{2} [ \d]\d [^\]]+)\] \[(?:(?<module>\w+):)?(?<level>\w+)\](?: \[pid (?<pid>\d+)(?::tid (?<tid>\d+))?\])?(?: \[client (?<c_ip>[^\]]+):(?<c_port>\d+)\])? (?<body>.*)$",
            r"^(?<level>[A-Z]) \[(?<timestamp>\d\d/[A-Z][a-z]{2}/\d{4}:[^\]]+)\] (?<body>.*)$",
        ),
        ("MMM d HH:mm:ss[.SSSSSS] yyyy", "dd/MMM/yyyy:HH:mm:ss XX"),
        {"pid": "bigint", "tid": "bigint", "c_port": "bigint"},
        WORDS,
        opid=("pid", "tid"),
        sample="[Mon Jan 01 00:00:07.179575 2024] [core:error] [pid 8:tid 9] [client 10.0.0.1:80] AH1: value 6.55",
    ),
    Format(
        "redis_log",
        (
            r"^(?<pid>\d+):(?<role>[XCSM]) (?<timestamp>\d{1,2} [A-Z][a-z]{2} \d{4} \d\d:\d\d:\d\d\.\d{3}) (?<level>[.*#-]) (?<body>.*)$",
            r"^\[(?<pid>\d+)\] (?<timestamp>\d{1,2} [A-Z][a-z]{2} \d\d:\d\d:\d\d\.\d{3}) (?<level>[.*#-]) (?<body>.*)$",
            f"^{layout('<pid:int>:<role> (<timestamp:int>) <body:line>')}$",
        ),
        ("d MMM yyyy HH:mm:ss.SSS", "yyyy d MMM HH:mm:ss.SSS", "epoch"),
        {"pid": "bigint"},
        (("warning", "^#"), ("notice", r"^\*"), ("info", "^-"), ("debug", r"^\.")),
        opid=("pid",),
        sample="1:M 01 Jan 2024 00:00:07.179 # value 6.55",
    ),
    Format(
        "spdlog_log",
        (
            rf"^\[(?<timestamp>{_ISO}[.,]\d{{3,6}})\]\[(?<thread_id>\d+)\]\[(?<level>\w+)\]\[(?<logger>[^\]]+)\] \[(?<src_file>[^:\]]+):(?<src_line>\d+)\] (?<body>.*)$",
            rf"^\[(?<timestamp>{_ISO}[.,]\d{{3,6}})\] \[(?<logger>[^\]]+)\] \[(?<level>\w+)\] (?<body>.*)$",
        ),
        ("yyyy-MM-dd HH:mm:ss[.SSSSSS][.SSS][,SSS]",),
        {"src_line": "bigint"},
        WORDS,
        opid=("thread_id",),
        sample="[2024-01-01 00:00:07.179] [shop] [error] value 6.55",
    ),
    Format(
        "env_logger_log",
        (rf"^\[(?<timestamp>{_ISO}\S*) (?<level>[A-Z]+)\s+(?<module>[^\]]+)\] (?<body>.*)$",),
        ("iso",),
        {},
        WORDS,
        opid=("module",),
        sample="[2024-01-01T00:00:07Z ERROR shop::app] value 6.55",
    ),
    Format(
        "mysql_error_log",
        (rf"^(?<timestamp>{_ISO}\.\d{{6}}\S*) (?<thread>\d+) \[(?<level>\w+)\](?: \[(?<err_code>[^\]]+)\] \[(?<subsystem>[^\]]+)\])? (?<body>.*)$",),
        ("iso",),
        {},
        (("error", "^Error"), ("warning", "^Warning"), ("info", ".")),
        opid=("thread",),
        sample="2024-01-01T00:00:07.179575Z 8 [Error] [MY-1] [InnoDB] value 6.55",
    ),
    Format(
        "dpkg_log",
        (rf"^(?<timestamp>{_ISO}(?:\.\d{{3}})?) (?<action>startup|status|configure|install|upgrade|trigproc|remove|purge) (?<body>.*)$",),
        ("yyyy-MM-dd HH:mm:ss[.SSS]",),
        {},
        (("info", "."),),
        "action",
        opid=("action",),
        sample="2024-01-01 00:00:07 status installed shop 6.55",
    ),
    Format(
        "cups_log",
        (r"^(?<level>[IEWD]) \[(?<timestamp>\d\d/[A-Z][a-z]{2}/\d{4}:\d\d:\d\d:\d\d [+-]\d{4})\] \[?(?<section>[A-Z]\w*)\]?: (?<body>.*)$",),
        ("dd/MMM/yyyy:HH:mm:ss XX",),
        {},
        WORDS,
        opid=("section",),
        sample="E [01/Jan/2024:00:00:07 +0000] StartListening: value 6.55",
    ),
    Format(
        "page_log",
        (r"^(?<printer>[\w.-]+) (?<username>[\w.-]+) (?<job_id>\d+) \[(?<timestamp>[^\]]+)\] (?<page_number>total|\d+) (?<num_copies>\d+) (?<job_billing>\S+) (?<job_originating_hostname>\S+)(?: (?<body>.*))?$",),
        ("dd/MMM/yyyy:HH:mm:ss XX",),
        {"job_id": "bigint", "num_copies": "bigint"},
        (("info", "."),),
        "printer",
        opid=("job_id",),
        sample="tec kurt 401 [01/Jan/2024:00:00:07 +0000] 1 3 #marketing 10.0.0.1",
    ),
    Format(
        "uwsgi_log",
        (
            # the server's documented layout, its variables by the names of their columns
            "^"
            + layout(
                "[pid: <s_pid:int>|app: <s_app:signed>|req: <s_req:signed>/<s_worker_reqs:int>] <c_ip> (<cs_username>) {<cs_vars:int> vars in <cs_bytes:int> bytes} [<> <timestamp>] <cs_method:word> <cs_uri_stem>[[?<cs_uri_query>]] => "
                "generated <sc_bytes:int> bytes in <s_runtime:int> msecs (<cs_version> <sc_status:int>) <sc_headers:int> headers in <sc_header_bytes:int> bytes (<s_switches:int> switches on core <s_core:int>)"
            )
            + "$",
        ),
        ("MMM d HH:mm:ss yyyy",),
        {"sc_status": "bigint", "sc_bytes": "bigint", "cs_bytes": "bigint", "s_runtime": "double"},
        (("error", "^[45]"), ("info", ".")),
        "sc_status",
        "cs_uri_stem",
        ("c_ip",),
        "[pid: 8|app: 0|req: 1/2] 10.0.0.1 () {44 vars in 1322 bytes} [Mon Jan  1 00:00:07 2024] GET /view?k=1 => generated 655 bytes in 21 msecs (HTTP/1.1 500) 4 headers in 188 bytes (1 switches on core 0)",
        duration=("s_runtime", 1000.0),
        stamp_is="end",
    ),
    Format(
        "elb_log",
        (
            rf'^(?<timestamp>{_ISO}\.\d+Z) (?<elb>\S+) (?<client_ip>[^ ]+):(?<client_port>\d+) (?<backend>\S+) (?<request_processing_time>-?[\d.]+) (?<backend_processing_time>-?[\d.]+) (?<response_processing_time>-?[\d.]+) '
            r'(?<elb_status_code>\d+|-) (?<backend_status_code>\d+|-) (?<received_bytes>\d+) (?<sent_bytes>\d+) "(?<cs_method>\S+) (?<cs_uri>\S+) (?<cs_version>[^"]+)" "(?<user_agent>[^"]*)" (?<ssl_cipher>\S+) (?<ssl_protocol>\S+)$',
        ),
        ("iso",),
        {"elb_status_code": "bigint", "backend_status_code": "bigint", "received_bytes": "bigint", "sent_bytes": "bigint", "request_processing_time": "double", "backend_processing_time": "double", "response_processing_time": "double"},
        (("error", "^[45]"), ("info", ".")),
        "elb_status_code",
        "cs_uri",
        ("client_ip",),
        '2024-01-01T00:00:07.179575Z lb 10.0.0.1:80 10.0.0.8:443 0.1 0.2 0.3 404 404 0 655 "GET https://shop.example/view HTTP/1.1" "agent" - -',
        duration=("backend_processing_time", 1.0),
    ),
    Format(
        "openstack_log",
        (
            rf"^(?<timestamp>{_ISO}\.\d{{3}}) (?<pid>\d+) (?<level>[A-Z]+) (?<logger>\S+) \[(?<tid>[^\]]+)\] (?<body>.*)$",
            rf"^\((?<logger>[^)]+)\): (?<timestamp>{_ISO},\d{{3}}) (?<level>[A-Z]+)(?: \((?<user>[^)]+)\))? (?<body>.*)$",
        ),
        ("yyyy-MM-dd HH:mm:ss[.SSS][,SSS]",),
        {"pid": "bigint"},
        WORDS,
        opid=("tid",),
        sample="2024-01-01 00:00:07.179 8 ERROR shop.wsgi [req-1 None] value 6.55",
    ),
    Format(
        "nextflow_log",
        (r"^(?<timestamp>[A-Z][a-z]{2}-\d\d \d\d:\d\d:\d\d\.\d{3}) \[(?<thread>[^\]]+)\] (?<level>[A-Z]+)\s+(?<module>\S+) - (?<body>.*)$",),
        ("yyyy MMM-dd HH:mm:ss.SSS",),
        {},
        WORDS,
        opid=("thread",),
        sample="Jan-01 00:00:07.179 [main] ERROR shop.App - value 6.55",
    ),
    Format(
        "logcat_log",
        (
            r"^(?<timestamp>\d\d-\d\d \d\d:\d\d:\d\d\.\d{3})\s+(?<pid>\d+)\s+(?<tid>\d+) (?<level>[VDIWEFA]) (?<component>[^:]+?)\s*: (?<body>.*)$",
            r"^(?<timestamp>\d\d-\d\d \d\d:\d\d:\d\d\.\d{3}) (?<level>[VDIWEFA])/(?<component>[^(]+?)\s*\(\s*(?<pid>\d+)\): (?<body>.*)$",
        ),
        ("yyyy MM-dd HH:mm:ss.SSS",),
        {"pid": "bigint", "tid": "bigint"},
        (("fatal", "^[FA]"), ("error", "^E"), ("warning", "^W"), ("info", "^I"), ("debug", "^D"), ("trace", "^V")),
        opid=("pid", "tid"),
        sample="01-01 00:00:07.179  8  9 E shop: value 6.55",
    ),
    Format(
        "proxifier_log",
        (r"^\[(?<timestamp>\d\d\.\d\d \d\d:\d\d:\d\d)\] (?<app_name>\S+(?: \*64)?) (?:-|(?<app_pid>\d+)) (?<target_host>[^: ]+):(?<target_port>\d+) (?:(?<level>error) : )?(?<body>.*)$",),
        ("yyyy MM.dd HH:mm:ss",),
        {"app_pid": "bigint", "target_port": "bigint"},
        (("error", "^error"), ("info", "")),
        opid=("app_name",),
        sample="[01.01 00:00:07] shop.exe - shop.example:443 error : value 6.55",
    ),
)
