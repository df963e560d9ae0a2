"""Schemas of the log relations, and severities."""

LEVELS = ("(none)", "ERROR", "WARNING", "NOTICE", "DEBUG")
SILENT, ERROR, WARNING, NOTICE, DEBUG = range(5)

FRAGMENT = "struct<arg_type:string,dyn_width:boolean,dyn_prec:boolean,fragment:string>"
ARG = "struct<type:string,width:int,prec:int,i:bigint,u:decimal(20,0),d:double,s:string,b:binary>"
EXECUTIONS = "file string, execution_id int, ckpt_rdtsc bigint, unix_time bigint, cycles_per_second double, new_metadata_bytes bigint, total_metadata_entries bigint"
DICTIONARY = f"file string, execution_id int, log_id bigint, filename string, line bigint, severity int, fmt string, num_nibbles int, fragments array<{FRAGMENT}>, valid boolean"
EXTENTS = "file string, execution_id int, stage_id int, extent_id bigint, thread_id bigint, offset bigint, bytes bigint"
EVENTS = f"file string, execution_id int, stage_id int, extent_id bigint, seq int, thread_id bigint, log_id bigint, rdtsc bigint, args array<{ARG}>"
#: Order of the file, and of time within an execution with the tie-break that the merge documents.
FILE_ORDER = ("file", "execution_id", "extent_id", "seq")
TIME_ORDER = ("file", "execution_id", "rdtsc", "stage_id", "extent_id", "seq")
KEY = ("file", "execution_id", "log_id")
