"""Schemas of stored documents. Unknown fields are ignored; absent ones are null."""

SECTION = (
    "struct<label:string,start_bar:int,end_bar:int,bar_count:int,start_time:double,end_time:double,start_time_str:string>"
)

ASSETS = "assets struct<result:string,audio:string,video:string,stems:map<string,string>>"

SESSION = f"""
    id string, title string, sourceType string, originalFilename string, sourceVideoId string,
    analysisStartSec double, analysisEndSec double, {ASSETS},
    bpm double, total_bars int, duration double, sections array<{SECTION}>, beats array<double>, downbeats array<double>,
    tags array<string>, lastPracticedAt string, practiceCount int, automaticSections array<{SECTION}>,
    sectionsEditedAt string, _corrupt string"""

LIBRARY = f"""
    id string, title string, bpm double, date string, {ASSETS}, tags array<string>, lastPracticedAt string,
    practiceCount int"""

FOLDER = "id string, name string, collapsed boolean, sessionIds array<string>"

JOB = """
    id string, stage string, message string, description string, kind string, display_title string, done boolean,
    error string, canceled boolean, cancel_requested boolean, started_at double, updated_at double, finished_at double,
    duration_seconds double, interrupted boolean, resumable boolean, archived boolean, source_job_id string,
    spec string, result string"""

INDEX = "version int, files map<string,string>"

ENTRY = "struct<deviceId:string,updatedAt:double,deletedAt:double,deleted:boolean,entryDate:string,digest:string,files:map<string,string>>"

REMOTE_STATE = f"version int, sessions map<string,{ENTRY}>, devices map<string,struct<name:string,lastSeenAt:double>>"

LOCAL_STATE = """
    version int, deviceId string, deviceName string, workspaceKey string,
    sessions map<string,struct<localDigest:string,remoteRevision:string>>,
    tombstones map<string,struct<deletedAt:double,deviceId:string>>"""

LOCAL_SESSION = "id string, localDigest string, remoteRevision string"

TOMBSTONE = "id string, deletedAt double, deviceId string"

DEVICE = "deviceId string, deviceName string, workspaceKey string"

JOB_EVENT = "id string, at timestamp, seq bigint, stage string, message string, done boolean, error string, cancel boolean"
