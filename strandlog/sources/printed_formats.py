"""Formats of the catalogue given by layouts: lines as their programs print them, with the names of columns in place of values.

A sample has its time as SAMPLE_TIME says it in the format's first layout, and BODY as its text.
"""

from __future__ import annotations

import re

from strandlog.sources.formats import WORDS, Format
from strandlog.sources.layouts import layout

BODY = "value 6.55"
ISO, COMMA, CLF, WEEKDAY = "iso", "yyyy-MM-dd HH:mm:ss,SSS", "dd/MMM/yyyy:HH:mm:ss XX", "MMM d HH:mm:ss[ zzz] yyyy"
#: 2024-01-01 00:00:07.179 in the layouts of samples.
SAMPLE_TIME = {
    ISO: "2024-01-01T00:00:07.179Z", COMMA: "2024-01-01 00:00:07,179", CLF: "01/Jan/2024:00:00:07 +0000", WEEKDAY: "Mon Jan  1 00:00:07 2024", "yyyy-MM-dd HH:mm:ss[.SSS]": "2024-01-01 00:00:07.179",
    "yyyyMMdd HH:mm:ss.SSS": "20240101 00:00:07.179", "yyyy MMM d HH:mm:ss": "Jan  1 00:00:07", "yyyy/MM/dd HH:mm:ss XXX": "2024/01/01 00:00:07 +00:00", "MM/dd/yyyy hh:mm:ss:SSS a zzz": "01/01/2024 12:00:07:179 AM UTC",
}
STATUS = (("error", "^[45]"), ("info", "."))
SHORT = (("critical", "^(Cr|Al|Em)"), ("error", "^Er"), ("warning", "^Wa"), ("notice", "^No"), ("info", "^In"), ("debug", "^Db"))
SECONDS = "double"
#: The bit of each level of the service's debug mask.
SSSD = (("fatal", "^0x0010"), ("critical", "^0x0020"), ("error", "^0x0040"), ("warning", "^0x0080"), ("info", "^0x0[12]00"), ("debug", "^0x0[48]00|^0x1000"), ("trace", "."))


def _format(name: str, text: str, times: tuple[str, ...], sample: str, levels=WORDS, kinds: dict[str, str] | None = None, level_field: str = "level", body: str = "body", opid: tuple[str, ...] = (), also: tuple[str, ...] = ()) -> Format:
    """A format of one layout; also: further patterns. Columns of numbers in the layout are numbers."""
    plain = f"^{layout(text)}$" if not text.startswith("^") else text
    numbers = {n: "bigint" for n in re.findall(r"<(\w+):(?:int|code)>", text)} | {n: "double" for n in re.findall(r"<(\w+):real>", text)}
    filled = sample.replace("@time", SAMPLE_TIME[times[0]]).replace("@body", BODY)
    return Format(name, (plain, *also), times, numbers | (kinds or {}), levels, level_field, body, opid, filled)


_STAMP = layout("<timestamp:stamp>")
_REQUEST = '"<cs_method:word> <cs_uri_stem:stem>[[?<cs_uri_query>]] <cs_version>"'

PRINTED = (
    _format(
        "alb_log",
        f"<type:letters> <timestamp:stamp> <elb:word> <client_ip>:<client_port:int> <target_ip>:<target_port:int> <request_processing_time:real> <target_processing_time:real> <response_processing_time:real> "
        f'<elb_status_code:code> <target_status_code:code> <received_bytes:int> <sent_bytes:int> {_REQUEST} "<user_agent>" <ssl_cipher:word> <ssl_protocol:word> <target_group_arn:word> "<trace_id>" <body:rest>',
        (ISO,), 'http @time app/lb/1 10.0.0.8:80 10.0.0.9:8080 0.1 0.2 -1 404 404 34 655 "GET http://shop.example:80/view?k=1 HTTP/1.1" "agent" - - arn:1 "Root=1" @body', STATUS, level_field="elb_status_code", opid=("client_ip",),
    ),
    _format(
        "s3_log",
        f'<owner:word> <bucket:word> [<timestamp:clf>] <c_ip:word> <cs_userid:word> <req_id:word> <op:word> <cs_key:word> {_REQUEST} <sc_status:code> <sc_error_code:word> <sc_bytes:code> <obj_size:code> <total_time:code> <turn_around_time:code> "<cs_referer>" "<cs_user_agent>" <body:rest>',
        (CLF,), 'owner shop [@time] 10.0.0.8 user 3E57 REST.GET.OBJECT view "GET /view?k=1 HTTP/1.1" 404 NoSuchKey 655 - 10 9 "-" "agent" @body', STATUS, level_field="sc_status", opid=("req_id",),
    ),
    _format("candlepin_log", "^" + _STAMP + r" \[(?:req)?=(?<req>[^,\n]*), org=(?<org>[^\]\n]*)\] " + layout("<level:word> <module:word> - <body:rest>") + "$", (COMMA,), "@time [req=8, org=] ERROR shop.App - @body", opid=("req",)),
    _format("choose_repo_log", "[<level:letters>:<logger>] <module>:<src_line:int> <timestamp:stamp>: <body:rest>", (COMMA,), "[ERROR:choose_repo] choose_repo:47 @time: @body"),
    _format("engine_log", "<timestamp:stamp> <level:letters> [<logger>] (<tid>) <body:rest>", (COMMA,), "@time ERROR  [shop.App] (worker-8) @body", opid=("tid",)),
    _format("esx_syslog_log", "<timestamp:stamp> <level:word> <log_procname>[<log_pid:int>]: <body:rest>", (ISO,), "@time Er(14) shop[8]: @body", SHORT, opid=("log_pid",)),
    _format("fsck_hfs_log", "<device>: fsck_hfs run at <timestamp:weekday>[[<body:rest>]]", (WEEKDAY,), "/dev/rdisk0s2: fsck_hfs run at @time @body", (("info", ""),), level_field="device", opid=("device",)),
    _format("idea_log", "<timestamp:stamp> [<millis_since_start:int>] <level:letters> - <logger_name:word> - <body:rest>", (COMMA,), "@time [352231305]   ERROR - #shop.App - @body"),
    _format("katello_log", "[<level:letters> <timestamp:stamp> <module>] <body:rest>", ("yyyy-MM-dd HH:mm:ss[.SSS]",), "[ERROR @time main]  @body"),
    _format("laravel_log", "[<timestamp:stamp>] <env>.<level:letters>: <body:rest>", ("yyyy-MM-dd HH:mm:ss[.SSS]",), "[@time] local.ERROR: @body"),
    _format("mysql_gen_log", "^" + _STAMP + r"\s+(?<thread>\d+) (?<command>[A-Z][A-Za-z ]*?)(?:\t| {2,})(?<body>.*)$", (ISO,), "@time\t   8 Query\t@body", (("info", "."),), level_field="command", opid=("thread",)),
    _format("mysql_slow_log", "# Time: <timestamp:stamp>[[ <body:rest>]]", (ISO, "yyMMdd HH:mm:ss"), "# Time: @time @body", (("info", ""),), level_field="body", also=(r"^# Time: (?<timestamp>\d{6} [ \d]\d:\d\d:\d\d)$",)),
    _format("openamdb_log", "<module:letters>:<timestamp:halfday>: <thread>[[\n<body:rest>]]", ("MM/dd/yyyy hh:mm:ss:SSS a zzz",), "amLog:@time: Thread[http-8]\nERROR: @body", (("error", "^ERROR"), ("warning", "^WARN"), ("info", "")), level_field="body", opid=("thread",)),
    _format("otlp_python_log", "<timestamp:stamp> <level:letters> [<logger>] [<src_file>:<src_line:int>] [<context>] - <body:rest>", (COMMA,), "@time ERROR [main] [shop.py:47] [trace_id=8 span_id=9] - @body"),
    _format("procstate_log", "========== Start of system state dump at <timestamp:weekday> ==========[[ <body:rest>]]", (WEEKDAY,), "========== Start of system state dump at @time ========== @body", (("info", ""),), level_field="body"),
    _format("cloudvm_ram_log", "========== Start of cloudvm ram size dump at <timestamp:weekday> ==========[[ <body:rest>]]", (WEEKDAY,), "========== Start of cloudvm ram size dump at @time ========== @body", (("info", ""),), level_field="body"),
    _format("rails_log", "<level_char:letters>, [<timestamp:stamp> #<pid:int>] <level:letters> -- <prog>: <body:rest>", (ISO,), "E, [@time #8] ERROR -- : @body", opid=("pid",)),
    _format("robot_fwk_log", "<timestamp:compact> - <level:letters> - <body:rest>", ("yyyyMMdd HH:mm:ss.SSS",), "@time - ERROR - @body"),
    _format("simple_rs_log", "<timestamp:stamp> <level:letters> [<module>] <body:rest>", (ISO,), "@time ERROR [shop::app] @body"),
    _format(
        "snaplogic_log", "<timestamp:stamp> <level:letters> <logger:word> <facility:word> <msgid:word> <pipe_rid:word> <comp_rid:word> <resource_name:word> <body:rest>",
        (ISO,), "@time ERROR main_process.main PM - 1768 - - @body", opid=("pipe_rid",),
    ),
    _format("sssd_log", "(<timestamp:weekday>) [<service:word>] [<function>] (<debug_level:hex>): <body:rest>", (WEEKDAY,), "(@time) [sssd[be[default]]] [find] (0x0040): @body", SSSD, level_field="debug_level", opid=("service",)),
    _format("unifi_log", "<timestamp:month> <host:word> <facility:letters>.<level:letters> <module>: <body:rest>", ("yyyy MMM d HH:mm:ss",), "@time gate user.err kernel: @body", opid=("module",)),
    _format(
        "vdsm_log", "<tid>::<level:letters>::<timestamp:stamp>::<module>::<src_line:int>::<logger>::(<func>) <body:rest>", (COMMA,), "Thread-8::ERROR::@time::dispatcher::94::Storage::(run) @body", opid=("tid",),
        also=(f"^{layout('<timestamp:stamp> <level:letters> (<thread>) [<logger>] <body:rest>')} " + r"\((?<module>\w+):(?<src_line>\d+)\)$",),
    ),
    _format("vmk_log", "<timestamp:stamp> [[<level:word> ]]cpu<cpu:int>:<world_id:int>)<body:rest>", (ISO,), "@time Er(3) cpu7:35233)@body", SHORT, opid=("world_id",)),
    _format(
        "vmw_log",
        "^" + _STAMP + r" (?<level>\w+) (?<prc>[^\s\[]+)\[(?<tid>[\w-]+)\] \[(?<src>Originator@\d+)(?: sub=(?<sub>[^\s\]]+))?(?: opID=(?<opid>[^\s\]]+))?[^\]]*\] (?<body>.*)$",
        (ISO,), "@time error vpxd[47413] [Originator@6876 sub=vpxLro opID=21fa-3e] @body", opid=("opid",),
        also=(r"^\[" + _STAMP + r" (?<tid>[0-9A-F]+) (?<level>\w+) '(?<comp>[^'\n]+)'(?: opID=(?<opid>[^\]\n]+))?\] (?<body>.*)$",),
    ),
    _format("vmw_py_log", "<timestamp:stamp> [<pid:int>]<level:letters>:<module>:<body:rest>", (ISO,), "@time [25376]ERROR:shop.app:@body", opid=("pid",)),
    _format("vmw_vc_svc_log", "^" + layout("<timestamp:stamp> <level:letters> <module:word> [<srcfile>:<srcline:int>] ") + r"(?:\[opID=(?<opid>[^\]\n]*)\] )?(?<body>.*)$", (ISO,), "@time error shop [app/util.go:148] [opID=8] @body", opid=("opid",)),
    _format(
        "vpostgres_log", "^" + layout("<timestamp:stamp> UTC <session_id:word> <transaction_id:word> <db_name:word> <user:word> <remote_pair:word> <pid:int> ") + r"(?<num_line>\d+)(?<level>[A-Z]+): +(?<body>.*)$",
        ("yyyy-MM-dd HH:mm:ss[.SSS]",), "@time UTC 64bf.21 0 SHOP u8 [local] 2227 5ERROR:  @body", opid=("session_id",), kinds={"num_line": "bigint"},
    ),
    _format("xmlrpc_log", "<timestamp:slashed> <pid:int> <client_ip>: <module>/<function>(<body:rest>", ("yyyy/MM/dd HH:mm:ss XXX",), "@time 8 10.0.0.8: xmlrpc/shop.view(@body)", (("info", ""),), level_field="function", opid=("pid",)),
    _format("zap_console_log", "^" + _STAMP + r"\t(?<level>[a-z]+)\t(?<src_file>[^:\t\n]+):(?<src_line>\d+)\t(?<body>.*)$", (ISO,), "@time\terror\tshop/app.go:87\t@body", kinds={"src_line": "bigint"}),
    _format("zellijFmt", "<level:letters> |<module> | <timestamp:stamp> [<module2>] [<src_file>:<src_line:int>]: <body:rest>", ("yyyy-MM-dd HH:mm:ss[.SSS]",), "ERROR  |shop                     | @time [main      ] [/src/lib.rs:179]: @body"),
)
