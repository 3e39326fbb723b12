"""Rule tables. All values here are fixed values that results depend on, given as they are."""

from __future__ import annotations

# Logon types.
LOGON_TYPES = {0: "System", 2: "Interactive", 3: "Network", 4: "Batch", 5: "Service", 7: "Unlock", 8: "NetworkCleartext", 9: "NewCredentials", 10: "RemoteInteractive", 11: "CachedInteractive", 12: "CachedRemoteInteractive", 13: "CachedUnlock"}

# Account management events (id, text, severity).
ACCOUNT_EVENTS = [
    (4720, "Account created", "HIGH"), (4722, "Account enabled", "MEDIUM"), (4724, "Password reset", "HIGH"), (4725, "Account disabled", "MEDIUM"), (4726, "Account deleted", "HIGH"),
    (4728, "Member added to global group", "HIGH"), (4732, "Member added to local group", "HIGH"), (4733, "Member removed from local group", "MEDIUM"), (4738, "User account changed", "MEDIUM"),
    (4740, "Account locked out", "MEDIUM"), (4756, "Member added to universal group", "HIGH"), (4781, "Account renamed", "HIGH"),
]
PRIVILEGED_GROUPS = ["Admin", "Domain Admins", "Enterprise Admins", "Schema Admins", "Backup Operators", "Remote Desktop Users", "Account Operators", "Server Operators", "Print Operators", "DnsAdmins"]

# Sensor events (id, text, severity).
SYSMON_EVENTS = [
    (2, "File creation time changed", "HIGH"), (6, "Driver loaded", "MEDIUM"), (7, "Image loaded (DLL)", "LOW"), (8, "CreateRemoteThread", "HIGH"), (15, "File stream (ADS)", "HIGH"),
    (17, "Named pipe created", "MEDIUM"), (18, "Named pipe connected", "MEDIUM"), (23, "File delete archived", "MEDIUM"), (25, "Process tampering", "CRITICAL"),
]
LSASS_MASKS = ["0x1010", "0x1410", "0x1FFFFF", "0x01410", "0x001010", "0x1038", "0x1000"]

# Signed binaries (binary, arguments or None for any, folders or None, severity, technique).
LOLBINS = [
    ("certutil.exe", ["-urlcache", "-decode", "-encode", "-decodehex", "-verifyctl"], None, "HIGH", "T1140"),
    ("mshta.exe", None, None, "HIGH", "T1218.005"),
    ("regsvr32.exe", ["/s", "/u", "/i:http", "scrobj.dll"], None, "HIGH", "T1218.010"),
    ("rundll32.exe", None, ["\\Temp\\", "\\Downloads\\", "\\AppData\\", "\\ProgramData\\", "\\Public\\"], "HIGH", "T1218.011"),
    ("msiexec.exe", ["/q", "http://", "https://", "/i http", "/i https"], None, "HIGH", "T1218.007"),
    ("regsvcs.exe", None, None, "MEDIUM", "T1218.009"),
    ("regasm.exe", None, None, "MEDIUM", "T1218.009"),
    ("installutil.exe", None, None, "MEDIUM", "T1218.004"),
    ("wmic.exe", ["process call create", "/node:", "os get", "/format:"], None, "HIGH", "T1047"),
    ("bitsadmin.exe", ["/transfer", "/create", "/addfile", "/resume"], None, "HIGH", "T1197"),
    ("schtasks.exe", ["/create"], None, "MEDIUM", "T1053.005"),
    ("net.exe", ["user /add", "localgroup administrators /add", 'group "Domain Admins"', "user /domain", "accounts /domain"], None, "HIGH", "T1136.001"),
    ("net1.exe", ["user /add", "localgroup administrators /add"], None, "HIGH", "T1136.001"),
    ("nltest.exe", ["/dclist", "/domain_trusts", "/dsgetdc", "/trusted_domains"], None, "MEDIUM", "T1482"),
    ("dsquery.exe", None, None, "MEDIUM", "T1018"),
    ("cscript.exe", None, ["\\Temp\\", "\\Downloads\\", "\\AppData\\", "\\Public\\"], "MEDIUM", "T1059.005"),
    ("wscript.exe", None, ["\\Temp\\", "\\Downloads\\", "\\AppData\\", "\\Public\\"], "MEDIUM", "T1059.005"),
    ("powershell.exe", ["-nop", "-w hidden", "-ep bypass", "-executionpolicy bypass", "IEX", "Invoke-Expression", "downloadstring", "Net.WebClient", "-enc", "-encodedcommand", "FromBase64String", "DownloadFile", "Start-BitsTransfer", "Invoke-WebRequest", "iwr", "curl", "-WindowStyle Hidden", "bypass", "-noni", "-noninteractive"], None, "HIGH", "T1059.001"),
    ("cmd.exe", ["/c echo", "/c powershell", "^", "%%", "|", "&"], None, "MEDIUM", "T1059.003"),
    ("msbuild.exe", None, None, "HIGH", "T1127.001"),
    ("cmstp.exe", ["/s", "/ni", "/au"], None, "HIGH", "T1218.003"),
    ("forfiles.exe", ["/c", "cmd", "powershell"], None, "MEDIUM", "T1202"),
    ("pcalua.exe", ["-a"], None, "HIGH", "T1202"),
]

# Web attack families in order (name, substrings, look in the path too, severity).
WEB_ATTACKS = [
    ("SQL Injection", ["UNION SELECT", "UNION ALL SELECT", "' OR 1=1", "' OR '1'='1", "WAITFOR DELAY", "xp_cmdshell", "INFORMATION_SCHEMA", "sysobjects", "BENCHMARK(", "SLEEP(", "' AND '", "1=1--", "' OR ''='", "CAST(", "CONVERT(", "@@version", "sys.databases"], True, "CRITICAL"),
    ("Command Injection", ["; ls", "| cat ", "&& whoami", "; id", "| nc ", "; wget ", "; curl ", "%0a", "`id`", "$(whoami)", "${IFS}", "; ping ", "| bash"], False, "CRITICAL"),
    ("Path Traversal", ["../", "..\\", "%2e%2e%2f", "%2e%2e/", "....//", "..%2f", "..%5c", "%252e%252e%252f", "....\\\\"], True, "HIGH"),
    ("XSS", ["<script", "javascript:", "onerror=", "onload=", "onclick=", "<img src", "<svg", "alert(", "document.cookie", "eval("], False, "HIGH"),
    ("Local File Inclusion", ["/etc/passwd", "/etc/shadow", "boot.ini", "win.ini", "php://filter", "php://input", "expect://", "data://"], True, "HIGH"),
    ("Remote File Inclusion", ["=http://", "=https://", "=ftp://"], False, "CRITICAL"),
]
SCANNERS = ["nikto", "sqlmap", "dirbuster", "gobuster", "wfuzz", "burp", "nmap", "masscan", "zgrab", "nuclei", "httpx", "ffuf", "acunetix", "nessus", "openvas", "qualys", "w3af", "skipfish", "arachni", "zap", "owasp", "spider", "crawler", "scanner"]

# Signatures (name, pattern, fields, severity, technique).
SIGNATURES = [
    ("procdump_lsass", r"(?:procdump|pd)(?:64)?\.exe.*?(?:-ma|-accepteula).*?(?:lsass|588)", ["command_line"], "CRITICAL", "T1003.001"),
    ("mimikatz", r"(?:mimikatz|sekurlsa|logonpasswords)", ["command_line", "process_name"], "CRITICAL", "T1003"),
    ("ntds_dit", r"(?:ntds\.dit|ntdsutil)", ["command_line", "file_path"], "CRITICAL", "T1003.003"),
    ("sam_dump", r"(?:reg\s+save.*?sam|secretsdump)", ["command_line"], "CRITICAL", "T1003.002"),
    ("invoke_wmiexec", r"Invoke-WMIExec", ["command_line"], "CRITICAL", "T1047"),
    ("invoke_smbexec", r"Invoke-SMBExec", ["command_line"], "CRITICAL", "T1021.002"),
    ("invoke_psexec", r"(?:Invoke-PSExec|PsExec)", ["command_line", "process_name"], "CRITICAL", "T1569.002"),
    ("wmic_process", r"wmic.*?(?:process\s+call\s+create|/node:)", ["command_line"], "HIGH", "T1047"),
    ("psexec_service", r"PSEXESVC", ["service_name"], "HIGH", "T1569.002"),
    ("webshell_aspx", r"(?:forbiden|cmd|shell|hack|c99|r57|b374k)\.aspx?", ["uri", "file_path"], "CRITICAL", "T1505.003"),
    ("w3wp_child", r"w3wp\.exe.*?(?:cmd|powershell|whoami|net|ipconfig)", ["command_line", "parent_process_name"], "CRITICAL", "T1505.003"),
    ("webshell_cmd_param", r"cmd=|exec=|command=|c=", ["query_string", "uri"], "HIGH", "T1505.003"),
    ("recon_whoami", r"whoami(?:\.exe)?(?:\s+/all)?", ["command_line"], "MEDIUM", "T1033"),
    ("recon_ipconfig", r"ipconfig(?:\.exe)?(?:\s+/all)?", ["command_line"], "MEDIUM", "T1016"),
    ("recon_net_user", r"net(?:1)?\.exe\s+(?:user|group|localgroup)", ["command_line"], "MEDIUM", "T1087"),
    ("recon_systeminfo", r"systeminfo(?:\.exe)?", ["command_line"], "MEDIUM", "T1082"),
    ("recon_tasklist", r"tasklist(?:\.exe)?", ["command_line"], "LOW", "T1057"),
    ("recon_netstat", r"netstat(?:\.exe)?", ["command_line"], "LOW", "T1049"),
    ("schtasks_create", r"schtasks(?:\.exe)?\s+/create", ["command_line"], "HIGH", "T1053.005"),
    ("reg_run_key", r"reg(?:\.exe)?\s+add.*?(?:Run|RunOnce)", ["command_line"], "HIGH", "T1547.001"),
    ("service_create", r"sc(?:\.exe)?\s+create", ["command_line"], "HIGH", "T1543.003"),
    ("random_service_name", r"^[A-Z]{20}$", ["service_name"], "CRITICAL", "T1543.003"),
    ("event_log_clear", r"(?:wevtutil.*?cl|Clear-EventLog)", ["command_line"], "CRITICAL", "T1070.001"),
    ("disable_defender", r"(?:Set-MpPreference.*?DisableRealtimeMonitoring|sc\s+stop\s+WinDefend)", ["command_line"], "CRITICAL", "T1562.001"),
    ("timestomp", r"(?:timestomp|touch.*?-t|-SetCreationTime)", ["command_line"], "HIGH", "T1070.006"),
    ("encoded_powershell", r"powershell.*?(?:-enc|-encodedcommand|-e\s)", ["command_line"], "HIGH", "T1059.001"),
    ("download_cradle", r"(?:DownloadString|DownloadFile|Invoke-WebRequest|wget|curl).*?http", ["command_line"], "HIGH", "T1105"),
    ("certutil_download", r"certutil.*?(?:-urlcache|-split)", ["command_line"], "HIGH", "T1105"),
    ("bitsadmin_download", r"bitsadmin.*?/transfer", ["command_line"], "HIGH", "T1105"),
    ("archive_compress", r"(?:7z|rar|zip|tar).*?(?:-p|password)", ["command_line"], "MEDIUM", "T1560"),
    ("clipboard_access", r"(?:Get-Clipboard|clip\.exe)", ["command_line"], "LOW", "T1115"),
    ("ransomware_extension", r"\.(?:encrypted|locked|crypt|enc|WNCRY|locky)", ["file_path"], "CRITICAL", "T1486"),
    ("volume_shadow_delete", r"(?:vssadmin.*?delete|wmic.*?shadowcopy.*?delete)", ["command_line"], "CRITICAL", "T1490"),
]

# Event ids (id, name, category, significance, expected number).
EVENT_IDS = [
    (4624, "Successful Logon", "Credential", "INFO", 1000), (4625, "Failed Logon", "Credential", "MEDIUM", 50), (4634, "Logoff", "Credential", "INFO", 1000),
    (4648, "Explicit Credential Logon", "Credential", "HIGH", 10), (4672, "Admin Logon", "Credential", "MEDIUM", 100), (4688, "Process Created", "Execution", "INFO", 5000),
    (4697, "Service Installed", "Persistence", "HIGH", 5), (4698, "Scheduled Task Created", "Persistence", "HIGH", 5), (4720, "User Created", "Persistence", "HIGH", 1),
    (4732, "User Added to Group", "Persistence", "HIGH", 2), (4768, "Kerberos TGT Request", "Credential", "INFO", 500), (4769, "Kerberos TGS Request", "Credential", "MEDIUM", 100),
    (4771, "Kerberos Pre-Auth Failed", "Credential", "HIGH", 10), (4776, "Credential Validation", "Credential", "INFO", 1000), (7045, "Service Installed", "Persistence", "HIGH", 5),
    (1102, "Audit Log Cleared", "Defense Evasion", "CRITICAL", 0), (1, "Process Create", "Execution", "INFO", 5000), (3, "Network Connection", "Lateral", "MEDIUM", 1000),
    (7, "Image Loaded", "Execution", "LOW", 10000), (8, "CreateRemoteThread", "Execution", "HIGH", 10), (10, "Process Access", "Credential", "MEDIUM", 100),
    (11, "File Create", "Collection", "LOW", 5000), (12, "Registry Create/Delete", "Persistence", "MEDIUM", 500), (13, "Registry Value Set", "Persistence", "MEDIUM", 500),
    (15, "File Stream Created", "Collection", "MEDIUM", 100), (17, "Pipe Created", "Lateral", "MEDIUM", 50), (18, "Pipe Connected", "Lateral", "MEDIUM", 50),
    (22, "DNS Query", "Discovery", "LOW", 5000), (23, "File Delete", "Defense Evasion", "LOW", 500),
]
FLAGGED_IDS = [4624, 4625, 4648, 4672, 4769, 4771, 4776, 4720, 4732, 4688, 4698, 7045, 1, 3, 11, 13, 22]

# Technique rules (technique, required with alternatives, supporting).
TECHNIQUES = [
    ("T1003.001", [["procdump_lsass", "mimikatz"]], ["process_access_lsass", "suspicious_handle"]),
    ("T1505.003", [["w3wp_child"]], ["webshell_aspx", "webshell_cmd_param"]),
    ("T1047", [["invoke_wmiexec", "wmic_process"]], ["wmiprvse_spawn"]),
    ("T1021.002", [["invoke_smbexec", "psexec_service"]], ["random_service_name"]),
    ("T1543.003", [["service_create", "event_7045"]], ["random_service_name"]),
    ("T1059.001", [["encoded_powershell"]], ["download_cradle"]),
    ("T1070.001", [["event_log_clear", "event_1102"]], []),
]

# Priority patterns of the triage scan (pattern, priority).
TRIAGE = [
    (r"w3wp\.exe", 1), (r"forbiden\.aspx", 1), (r"forbidden\.aspx", 1), (r"cmd\.aspx", 1), (r"shell\.aspx", 1), (r"IIS APPPOOL", 1), (r"DefaultAppPool", 1),
    (r"pd\.exe", 1), (r"pd64\.exe", 1), (r"procdump\.exe", 1), (r"-accepteula.*-ma", 1), (r"-ma\s+\d+", 1), (r"lsass", 1), (r"\.dmp", 1), (r"mimikatz", 1), (r"sekurlsa", 1),
    (r"Invoke-WMIExec", 1), (r"Invoke-SMBExec", 1), (r"Invoke-TheHash", 1), (r"iwe\.ps1", 1), (r"ise\.ps1", 1), (r"-Hash\s+[a-fA-F0-9]{32}", 1), (r"-Target\s+\d+\.\d+\.\d+\.\d+", 1),
    (r"-[eE][nN][cC]\s", 2), (r"-[eE]ncoded[cC]ommand\s", 2), (r"[A-Za-z0-9+/]{50,}={0,2}", 2), (r"-[wW]\s*[hH]idden", 2), (r"-[nN]o[pP]", 2), (r"-[eE]xec\s*[bB]ypass", 2),
    (r"cmd\.exe\s*/[cC]", 2), (r"cmd\s*/[cC]", 2), (r"certutil.*-urlcache", 2), (r"certutil.*-decode", 2), (r"mshta\s+http", 2), (r"regsvr32.*\/s.*\/u.*http", 2), (r"rundll32.*javascript", 2),
    (r"wmic.*process.*call.*create", 2), (r"bitsadmin.*\/transfer", 2), (r"schtasks.*\/create", 2), (r"psexec", 2), (r"wmiexec", 2), (r"winrm", 2),
    (r"net\s+user", 3), (r"net\s+localgroup", 3), (r"nltest", 3), (r"whoami", 3), (r"ipconfig\s*/all", 3), (r"ipconfig", 3), (r"systeminfo", 3), (r"tasklist", 3), (r"netstat", 3), (r"wmic\s+process\s+list", 3),
    (r"SELECT.*FROM.*WHERE", 3), (r"UNION\s+SELECT", 3), (r"\.\./\.\./", 3), (r"%2e%2e%2f", 3), (r"<script", 3), (r"\.asp[x]?\?", 3), (r"cmd=", 3), (r"exec=", 3), (r"powershell\.exe", 4), (r"splunk-powershell", 4),
]

# Process classes, parents and pairs.
SYSTEM_PROCESSES = ["svchost.exe", "lsass.exe", "csrss.exe", "wininit.exe", "smss.exe", "services.exe", "winlogon.exe", "dwm.exe", "explorer.exe", "spoolsv.exe", "lsaiso.exe", "fontdrvhost.exe", "sihost.exe", "taskhostw.exe"]
WINDOWS_TOOLS = ["cmd.exe", "powershell.exe", "pwsh.exe", "net.exe", "net1.exe", "whoami.exe", "ipconfig.exe", "ping.exe", "nslookup.exe", "tracert.exe", "netstat.exe", "systeminfo.exe", "hostname.exe", "tasklist.exe", "taskkill.exe", "sc.exe", "reg.exe", "wmic.exe", "mshta.exe", "cscript.exe", "wscript.exe", "certutil.exe", "bitsadmin.exe", "rundll32.exe", "regsvr32.exe", "msiexec.exe", "curl.exe", "wget.exe"]
ATTACK_TOOLS = ["mimikatz.exe", "procdump.exe", "pd.exe", "procdump64.exe", "psexec.exe", "psexec64.exe", "wce.exe", "gsecdump.exe", "lazagne.exe", "bloodhound.exe", "sharphound.exe", "rubeus.exe", "kekeo.exe", "safetykatz.exe", "logonpasswords.exe", "secretsdump.exe", "crackmapexec.exe", "covenant.exe", "cobalt", "beacon", "meterpreter"]
WEB_SERVERS = ["w3wp.exe", "httpd.exe", "nginx.exe", "apache.exe", "tomcat.exe", "java.exe", "node.exe", "iisexpress.exe", "webengine4.exe"]
SYSTEM_ACCOUNTS = ["system", "local service", "network service", "nt authority\\system", "nt authority\\local service", "nt authority\\network service"]
EXPECTED_PARENTS = {"chrome.exe": ["explorer.exe", "chrome.exe"], "firefox.exe": ["explorer.exe", "firefox.exe"], "notepad.exe": ["explorer.exe", "cmd.exe", "powershell.exe"], "calc.exe": ["explorer.exe"], "svchost.exe": ["services.exe"], "csrss.exe": ["smss.exe"], "wininit.exe": ["smss.exe"], "winlogon.exe": ["smss.exe"], "lsass.exe": ["wininit.exe"], "services.exe": ["wininit.exe"], "explorer.exe": ["userinit.exe", "winlogon.exe"]}
RARE_PARENTS = ["w3wp.exe", "httpd.exe", "nginx.exe", "sqlservr.exe", "oracle.exe", "mysqld.exe", "lsass.exe"]
BAD_PAIRS = [("w3wp.exe", "cmd.exe"), ("w3wp.exe", "powershell.exe"), ("w3wp.exe", "whoami.exe"), ("w3wp.exe", "net.exe"), ("w3wp.exe", "net1.exe"), ("sqlservr.exe", "cmd.exe"), ("sqlservr.exe", "powershell.exe"), ("excel.exe", "cmd.exe"), ("excel.exe", "powershell.exe"), ("winword.exe", "cmd.exe"), ("winword.exe", "powershell.exe"), ("outlook.exe", "cmd.exe"), ("outlook.exe", "powershell.exe")]

# Words that tell a session's intent.
INTENTS = {
    "RECON": ["whoami", "ipconfig", "hostname", "systeminfo", "net user", "net group", "net localgroup", "net view", "net share", "tasklist", "netstat", "qprocess", "qwinsta", "query user"],
    "CREDENTIAL": ["mimikatz", "procdump", "pd.exe", "sekurlsa", "lsass", "sam", "ntds", "credential", "password", "hash", "kerberos", "ticket"],
    "LATERAL": ["psexec", "wmic", "invoke-wmiexec", "invoke-smbexec", "invoke-psexec", "enter-pssession", "invoke-command", "winrm"],
    "STAGING": ["downloadstring", "downloadfile", "wget", "curl", "bitsadmin", "certutil", "invoke-webrequest"],
}

# Indicator patterns of free text.
IOC_PATTERNS = {
    "ipv4": r"\b(?:(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\.){3}(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\b",
    "ipv6": r"\b(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}\b",
    "domain": r"\b(?:[a-zA-Z0-9](?:[a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?\.)+[a-zA-Z]{2,}\b",
    "url": r"https?://[^\s<>\"']+",
    "md5": r"\b[a-fA-F0-9]{32}\b",
    "sha1": r"\b[a-fA-F0-9]{40}\b",
    "sha256": r"\b[a-fA-F0-9]{64}\b",
    "email": r"\b[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}\b",
}

# Parts that no domain of interest holds, and endings that files have.
NO_DOMAINS = [
    "microsoft.com", "windows.com", "windowsupdate.com", "google.com", "googleapis.com", "gstatic.com", "amazon.com", "amazonaws.com", "cloudflare.com", "cloudflare-dns.com", "localhost", "local",
    ".exe", ".dll", ".sys", ".com", ".bat", ".cmd", ".ps1", ".log", ".txt", ".json", ".xml", ".csv", ".dat", ".tmp", ".dmp", ".evtx", ".etl", ".msi", ".cab",
]
FILE_ENDINGS = ["exe", "dll", "sys", "com", "bat", "cmd", "log", "txt", "dat", "dmp", "msi"]

# Programs of the system and the only parents that start them; programs that documents exploit and
# the parents that open those; words of credential dumpers.
SYSTEM_PARENTS = {
    "svchost.exe": ["services.exe"], "csrss.exe": ["smss.exe"], "wininit.exe": ["smss.exe"], "services.exe": ["wininit.exe"], "lsass.exe": ["wininit.exe"], "lsaiso.exe": ["wininit.exe"],
    "taskhost.exe": ["svchost.exe", "services.exe"], "taskhostw.exe": ["svchost.exe", "services.exe"], "runtimebroker.exe": ["svchost.exe"], "dllhost.exe": ["svchost.exe", "services.exe"], "wmiprvse.exe": ["svchost.exe"],
}
EXPLOIT_PARENTS = {"acrord32.exe": ["firefox.exe", "iexplore.exe", "chrome.exe", "outlook.exe"], "winword.exe": ["explorer.exe"], "excel.exe": ["explorer.exe"], "powerpnt.exe": ["explorer.exe"]}
DUMP_WORDS = ["pd.exe", "pd64.exe", "procdump", "mimikatz", "lsass", "-ma "]
#: Programs that run commands or scripts.
SHELLS = ["cmd.exe", "powershell.exe", "pwsh.exe", "wscript.exe", "cscript.exe", "mshta.exe", "bash.exe"]
