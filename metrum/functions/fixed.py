"""Fixed values. Results depend on these exact numbers, words and patterns."""

# Pitch-class names, from C upwards.
NOTES = ("C", "C#", "D", "D#", "E", "F", "F#", "G", "G#", "A", "A#", "B")

# Enharmonic names besides NOTES, with their pitch class.
FLATS = {"Db": 1, "Eb": 3, "Gb": 6, "Ab": 8, "Bb": 10}

# Major and minor key profiles (Krumhansl and Kessler).
MAJOR_PROFILE = (6.35, 2.23, 3.48, 2.33, 4.38, 4.09, 2.52, 5.19, 2.39, 3.66, 2.29, 2.88)
MINOR_PROFILE = (6.33, 2.68, 3.52, 5.38, 2.60, 3.53, 2.54, 4.75, 3.98, 2.69, 3.34, 3.17)

# Scale degrees by distance from the tonic.
DEGREES = ("I", "♭II", "II", "♭III", "III", "IV", "♭V", "V", "♭VI", "VI", "♭VII", "VII")

# Chord suffixes with their intervals above the root.
CHORDS = (
    ("", (0, 4, 7)),
    ("m", (0, 3, 7)),
    ("5", (0, 7)),
    ("sus2", (0, 2, 7)),
    ("sus4", (0, 5, 7)),
    ("dim", (0, 3, 6)),
    ("aug", (0, 4, 8)),
    ("7", (0, 4, 7, 10)),
    ("maj7", (0, 4, 7, 11)),
    ("m7", (0, 3, 7, 10)),
)

# Open strings of a guitar as MIDI notes, from the top line down.
TUNING = (64, 59, 55, 50, 45, 40)

# Names of separated tracks.
STEMS = ("vocals", "drums", "bass", "other")

# Labels that mean the same section, after lower-casing and replacing "_" by "-".
LABEL_ALIASES = {
    "verse": ("aメロ", "a-melo"),
    "pre-chorus": ("bメロ", "b-melo"),
    "chorus": ("サビ", "hook"),
}

# Section class by the first alias contained in a label.
LABEL_CLASSES = (
    ("pre-chorus", "pre-chorus"),
    ("bメロ", "pre-chorus"),
    ("intro", "intro"),
    ("イントロ", "intro"),
    ("verse", "verse"),
    ("aメロ", "verse"),
    ("chorus", "chorus"),
    ("サビ", "chorus"),
    ("bridge", "bridge"),
    ("cメロ", "bridge"),
    ("outro", "outro"),
    ("アウトロ", "outro"),
    ("interlude", "intro"),
    ("instrumental", "intro"),
    ("inst", "intro"),
    ("間奏", "intro"),
)

# Japanese section names by the first English name contained in a label.
LABEL_NAMES = (
    ("pre-chorus", "Bメロ"),
    ("post-chorus", "後サビ"),
    ("intro", "イントロ"),
    ("verse", "Aメロ"),
    ("chorus", "サビ"),
    ("bridge", "Cメロ"),
    ("interlude", "間奏"),
    ("instrumental", "間奏"),
    ("inst", "間奏"),
    ("solo", "ソロ"),
    ("start", "開始"),
    ("outro", "アウトロ"),
    ("ending", "エンディング"),
    ("end", "アウトロ"),
)

# Hosts of video addresses, by where the id is found.
SHORT_HOSTS = ("youtu.be",)
QUERY_HOSTS = ("www.youtube.com", "youtube.com", "m.youtube.com")

# Player settings that may be stored.
SETTING_KEYS = (
    "volMusic",
    "volMetro",
    "playbackRate",
    "loop",
    "metro",
    "autoNext",
    "sidebarFolders",
    "sidebarFolderCollapsed",
    "sidebarRootOrder",
    "lastStructureSessionId",
    "stemMix",
    "stemLastVolume",
    "stemMixMode",
    "stemMixRestore",
)
SETTING_PREFIXES = ("bpmFactor:", "clickOffsetHalfBeat:")
SETTING_BYTES = 256 * 1024

# Analyser log lines. (how matched, text, stage, message; no message means the line itself)
LOG_STAGES = (
    ("starts", "Separated tracks will be stored", "demixing", "Preparing source separation"),
    ("starts", "Separating track ", "demixing", "Separating stems"),
    ("contains", "tracks already demixed", "demixing", None),
    ("contains", "spectrograms already extracted", "extracting", None),
    ("starts", "Extracting spectrograms", "extracting", "Extracting spectrograms"),
    ("starts", "Analyzing ", "inferencing", None),
    ("contains", "tracks already analyzed", "inferencing", None),
    ("starts", "[INFO] CUDA backend is unavailable", "inferencing", None),
    ("starts", "[INFO] Starting all-in-one-fix analysis", "inferencing", None),
    ("starts", "[INFO] Finished all-in-one-fix analysis", "inferencing", None),
)

# Job messages and their Japanese text.
MESSAGES = {
    "Complete": "完了しました",
    "Canceled": "キャンセルしました",
    "Cancel requested": "キャンセルを要求しました",
    "Application restarted; resume when ready": "前回の終了時に中断されました。準備ができたら再開してください",
    "Queued": "処理一覧に追加しました",
    "Queued analysis": "解析を処理一覧に追加しました",
    "Queued local audio analysis": "音声ファイルの解析を処理一覧に追加しました",
    "Queued stem separation": "パート分離を処理一覧に追加しました",
    "Queued stem mix export": "パート書き出しを処理一覧に追加しました",
    "Queued cloud sync": "端末間同期を処理一覧に追加しました",
    "Queued score preview": "楽譜プレビューを処理一覧に追加しました",
    "Queued score extraction": "楽譜抽出を処理一覧に追加しました",
    "Rendering stem mix": "パートのミックスを書き出しています",
    "Analysis timed out": "解析がタイムアウトしました",
    "Separating stems": "パートを分離しています",
    "Loaded from cache": "保存済みの解析結果を読み込みました",
    "Fetching title": "動画タイトルを取得しています",
    "Downloading audio": "音声をダウンロードしています",
    "Using cached audio": "保存済みの音声を使用します",
    "Downloading video": "動画をダウンロードしています",
    "Using cached video": "保存済みの動画を使用します",
    "Preparing playback mp3": "再生用の音声を準備しています",
    "Preparing uploaded audio": "音声ファイルを変換しています",
    "Preparing playback video": "再生用の動画を準備しています",
    "Saving results": "解析結果を保存しています",
    "Analysis complete": "解析が完了しました",
    "Preparing cloud asset URLs": "クラウド用URLを準備しています",
    "Uploading session assets to R2": "楽曲データをクラウドへ送信しています",
    "Stems ready": "パートの準備ができました",
    "Exporting static assets": "公開用データを書き出しています",
    "Updating R2 CORS": "クラウドの接続設定を更新しています",
    "Uploading manifest": "楽曲一覧をクラウドへ送信しています",
    "Uploading folders": "フォルダー情報をクラウドへ送信しています",
    "Uploading static app": "アプリをクラウドへ送信しています",
}

# Japanese names of the tracks, used in encoding messages.
STEM_NAMES_JA = {"vocals": "ボーカル", "drums": "ドラム", "bass": "ベース", "other": "その他"}

# Categories of the storage report; those that may be cleared; names never cleared from "work".
STORAGE_CATEGORIES = (
    "work",
    "logs",
    "model-cache",
    "source-audio",
    "source-video",
    "source-stems",
    "score-work",
    "results",
    "public-assets",
)
CLEARABLE_CATEGORIES = ("work", "logs", "model-cache")
PROTECTED_NAMES = ("uploads", "stem-exports", "r2-sync-cache.json")

# Messages of a job that was stopped, and of one that was asked to stop.
CANCELED_MESSAGE = "Canceled"
CANCEL_REQUESTED_MESSAGE = "Cancel requested"

# Messages of the job monitor; the first with the seconds since the start.
RUNNING_MESSAGE = "Analyzer running for %ds"
