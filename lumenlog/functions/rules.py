"""Ordered keyword rules and the compiler that turns a list into one Column.

A rule list is plan-time configuration: it becomes an expression over each line, never a join of lines with rules.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumenlog.functions.timeparse import let

# Keyword lists, patterns and sets that results depend on, in the order in which they are tried.
INTERPRETERS = ["python -c", "python2 -c", "python3 -c", "perl -e", "ruby -e", "php -r"]
SHELLS = ["bash -i", "sh -i", "zsh -i"]
WRITABLE = ["/tmp/", "/dev/shm/", "/var/tmp/"]
AUTOMATION = ["BECOME-SUCCESS", "ansible", "AnsiballZ"]

SUDO_HIGH = [
    "/bin/bash", "/bin/sh", "/usr/bin/bash", "/usr/bin/sh", *INTERPRETERS, "nc ", "netcat", "ncat", "socat", "bash -i", "sh -i", *WRITABLE,
    "base64 -d", "base64 --decode", "mkfifo", "mknod", "chmod +x", "chmod 777", "wget -O /tmp", "curl -o /tmp",
]
EXEC_CRITICAL = [
    *SHELLS, *INTERPRETERS, "nc ", "netcat", "ncat", "socat", "mkfifo", "mknod", *WRITABLE, "base64 -d", "base64 --decode", "wget -O /tmp", "curl -o /tmp",
    "chattr +i", "0>&1", ">&2",
]
CRON_WHITELIST = [
    "/usr/lib/sa/sa1", "/usr/lib/sa/sa2", "logrotate", "/usr/libexec/atrun", "/usr/bin/updatedb", "/usr/bin/yum-cron", "run-parts", "/etc/cron.",
    "/usr/bin/freshclam", "/usr/bin/mandb", "/usr/lib64/nagios/plugins/check", "/usr/bin/test", "/usr/bin/stat", "/usr/bin/true", *AUTOMATION,
]
SYSTEM_CRITICAL = [
    "panic", "kernel panic", "oops:", "bug:", "oom", "out of memory", "killed process", "segfault", "general protection fault", "call trace",
    "hardware error", "mce:", "i/o error", "ext4-fs error", "filesystem error", "raid.*degraded", "md.*degraded",
]
SYSTEM_NOISE = [
    "authentication failure", "connection refused", "connection timed out", "permission denied", "operation not permitted", "disk quota exceeded",
    "no space left on device", "too many open files", "address already in use",
]
QUIET_DAEMONS = ["cron", "crond", "anacron", "systemd", "systemd-logind"]
MESSAGES_CRITICAL = [
    "oom", "out of memory", "killed process", "kernel panic", "panic occurred", "segfault", "general protection fault", "call trace", "bug:", "oops:",
    "hardware error", "mce:", "machine check", "i/o error", "filesystem error", "ext4-fs error", "raid.*degraded", "md.*degraded",
]
AUDIT_CRITICAL_TYPES = ["ANOM_ABEND", "ANOM_PROMISCUOUS", "KERN_MODULE", "MAC_POLICY_LOAD", "ANOM_EXEC", "ANOM_MK_EXEC", "ANOM_LINK"]
AUDIT_NOISE_TYPES = ["PROCTITLE", "PATH", "CWD", "BPRM_FCAPS", "MMAP", "SOCKADDR", "NETFILTER_PKT"]
URI_ATTACKS = [
    "union+select", "union%20select", "union select", "sleep(", "benchmark(", "' or '", "1=1", "../../../", "../../", "%2e%2e", "%252e", "/etc/passwd",
    "/etc/shadow", "/proc/self", "cmd.php", "shell.php", "c99.php", "r57.php", "eval(", "base64_decode(", "<script>", "%3cscript", "javascript:",
    "onerror=", "onload=", "/phpmyadmin", "/adminer", "/.env", "/.git/config", "/wp-config.php", "/xmlrpc.php", "/.htpasswd", "sqlmap", "nikto",
    "masscan", "%00",
]
URI_NOISE = ["wp-login", "wp-admin", "/admin", "/login", "/.well-known", "/robots.txt", "/favicon.ico"]
SHELL_CRITICAL = [
    *SHELLS, "/dev/tcp/", "/dev/udp/", "0>&1", ">&/dev/null", *INTERPRETERS, "node -e", "nc -l", "ncat -l", "socat", "mkfifo", "cat /etc/shadow",
    "cat /etc/passwd", "unshadow", "john ", "hashcat", "mimikatz", "pypykatz", "history -c", "history -w /dev/null", "unset HISTFILE",
    "HISTFILE=/dev/null", "shred -u", "shred /var/log", "rm -rf /var/log", "rm -f /var/log", "chmod +s", "chmod u+s", "chattr +i", "pkexec", "insmod ",
    "modprobe ", "wget -O /tmp", "wget -o /tmp", "curl -o /tmp", "curl -O /tmp", "curl -s http", "curl -sS http", *WRITABLE, "msfconsole", "msfvenom",
    "Empire", "Covenant", "chisel", "ligolo", "crackmapexec", "cme ", "impacket", "secretsdump",
]
SHELL_SUSPICIOUS = [
    "wget ", "curl ", "scp ", "rsync ", "sudo su", "su -", "su root", "visudo", "useradd", "adduser", "usermod", "groupadd", "passwd ", "crontab -e",
    "systemctl enable", "systemctl start", "~/.bashrc", "~/.bash_profile", "~/.profile", "/etc/rc.local", "nmap ", "masscan ", "zmap ", "netstat", "ss -",
    "lsof ", "ps aux", "ps -ef", "find / -perm", "find / -suid", "apt install nmap", "apt-get install nmap", "pip install impacket", "pip3 install",
    "ssh-keygen", "authorized_keys", "base64 -d", "base64 --decode", "openssl enc", "tar czf", "zip -r",
]
SHELL_WHITELIST = [
    "ls ", "ls\t", "ls -", "cd ", "pwd", "echo ", "cat ", "grep ", "awk ", "sed ", "vim ", "vi ", "nano ", "less ", "more ", "man ", "history", "exit",
    "logout", "git ", "make ", "cmake ", "docker ps", "docker images", "docker logs", "kubectl get", "kubectl describe", "systemctl status",
    "systemctl list", "journalctl", "df ", "du ", "free ", "top", "htop", "ping ", "dig ", "nslookup ", "apt list", "apt show", "dpkg -l", "yum list",
    "rpm -q",
]
CAT_EXCEPTIONS = ["/etc/shadow", "/etc/passwd", "/etc/sudoers"]
ANTI_FORENSICS = ["history -c", "history -w /dev/null", "unset histfile", "histfile=/dev/null", "rm -rf /var/log", "rm -f /var/log"]
JOB_CRITICAL = [
    *SHELLS, *INTERPRETERS, "nc ", "netcat", "ncat", "socat", "mkfifo", "mknod", *WRITABLE, "base64 -d", "base64 --decode", "wget -O /tmp", "wget -o /tmp",
    "curl -o /tmp", "curl -O /tmp", "chattr +i", "0>&1", ">&2", "backdoor", "rootkit", "payload", "reverse",
]
JOB_SUSPICIOUS = ["wget", "curl", "http://", "https://", "ftp://", "ssh", "scp", "rsync", "openssl"]
JOB_WHITELIST = [
    "/usr/lib/sa/sa1", "/usr/lib/sa/sa2", "logrotate", "/usr/libexec/atrun", "/usr/bin/updatedb", "/usr/bin/yum-cron", "run-parts", "/etc/cron.",
    "/usr/bin/freshclam", "/usr/bin/mandb", "/usr/lib64/nagios/plugins", "/usr/bin/test", "/usr/bin/stat", "/usr/bin/true", *AUTOMATION, "apt-get", "dpkg",
    "rpm", "yum", "dnf", "/usr/bin/find", "/usr/bin/locate",
]
JOURNAL_CRITICAL = [
    *INTERPRETERS, "lua -e", *SHELLS, "ksh -i", "dash -i", "socat", "mkfifo", "mknod", "base64 -d", "base64 --decode", "0>&1", ">&2", "backdoor", "rootkit",
    "exploit", "payload", "wget -q -O- |", "wget -qO- |", "curl -s |", "curl -fsSL |", "wget -q -O /tmp", "wget -O /tmp", "wget -O /dev/shm",
    "curl -o /tmp", "curl -o /dev/shm", "chattr +i", "chattr -i",
]
JOURNAL_EXE_PATHS = ["/tmp/", "/dev/shm/", "/var/tmp/", "/run/user/"]
JOURNAL_NOISE = ["wget", "curl", "nc ", "netcat", "ncat", "chmod +x", "chmod 777", "xxd", "dd if=", "2>&1"]
SERVICE_ACCOUNTS = [
    "www-data", "apache", "nginx", "httpd", "mysql", "postgres", "postgresql", "redis", "mongodb", "nobody", "daemon", "bin", "sys", "sync", "games",
    "man", "lp", "mail", "news", "uucp", "proxy", "backup", "list", "irc", "gnats", "_apt", "messagebus", "systemd-network", "systemd-resolve",
]
BODY_KEYWORDS = [
    "reverse_shell", "backdoor", "mimikatz", "c2", "creds", "payload", "dump", "chattr", "shadow", "netcat", "nc ", "/nc", "suid", "exploit", "ps1",
    "lateral", "exfil", "xmr", "xmrig", "crypto", "miner", "bash -i", "socat", "pkexec", "wget", "curl", "/bash -i",
]
BODY_WHITELIST = [
    "/usr/", "/lib", "/etc/", "/proc/", "/sys/", "/boot/", "/var/log/", "/var/cache/", "/var/run/", "/opt/CrowdStrike/", "/tmp/CSIRT_Collection/",
]
FRAMEWORK_CACHES = [
    "/phpMyAdmin/tmp/twig/", "/twig/cache/", "/smarty/templates_c/", "/cache/smarty/", "/compiled/", "/symfony/cache/", "/laravel/cache/",
    "storage/framework/cache/", "storage/framework/views/", "/doctrine/cache/", "/phpfastcache/", "/__pycache__/", "/.git/objects/",
]
BODY_PATH_HINTS = ["/tmp", "/dev/shm", "/var/tmp", "/run", "/root", "/home", "/mnt", "/media"]
BENIGN_EXTENSIONS = [
    ".log", ".conf", ".cfg", ".cnf", ".ini", ".repo", ".service", ".socket", ".target", ".wants", ".txt", ".json", ".xml", ".yaml", ".yml", ".md",
    ".html", ".htm", ".css", ".js", ".rpmnew", ".rpmsave", ".bak", ".old", ".save", ".tmp", ".swp", ".lock",
]
EXEC_EXTENSIONS = [".elf", ".bin", ".run", ".so"]
HASH_WHITELIST = [
    "/usr/share/", "/usr/lib/", "/usr/bin/", "/usr/sbin/", "/usr/local/share/", "/usr/local/lib/", "/lib/", "/lib64/", "/lib32/", "/bin/", "/sbin/",
    "/boot/", "/etc/", "/proc/", "/sys/", "/var/lib/dpkg/", "/var/lib/apt/", "/var/cache/apt/", "/var/lib/rpm/", "/opt/CrowdStrike/", "/opt/splunk/",
    "/opt/nessus/", "/tmp/CSIRT_Collection/",
]
HASH_HIGH_PATHS = ["/tmp/", "/dev/shm/", "/var/tmp/", "/run/", "/root/", "/home/", "/mnt/", "/media/", "/.local/", "/.config/", "/.cache/"]
HASH_MEDIUM_PATHS = ["/opt/", "/srv/", "/var/www/", "/usr/local/bin/", "/usr/local/sbin/"]
HASH_KEYWORDS = [
    "backdoor", "shell", "reverse", "exploit", "payload", "c2", "netcat", "ncat", "nc.", "socat", "xmrig", "miner", "crypto", "mimikatz", "dump", "inject",
    "hook", "rootkit", "stager", "beacon", "agent", "rat.", "implant", "pwn", "crack", "bypass", "escalate", "priv", "keylog", "exfil", "lateral",
]
HASH_EXTENSIONS = [".elf", ".so", ".bin", ".run", ".out", ".x86", ".x64", ".arm", ".mips", ".sh", ".py", ".pl", ".rb", ".ps1"]
CONTAINER_EXEC = [
    *SHELLS, *INTERPRETERS, "nc -e", "nc -l", "netcat", "ncat", "socat", "mkfifo", "mknod", "/tmp/", "/dev/shm/", "base64 -d", "base64 --decode",
    "wget http", "curl http", "xmrig", "stratum+tcp", "cmd.php", "shell.php", "backdoor", "reverse shell",
]
CONTAINER_CAPS = ["SYS_ADMIN", "SYS_PTRACE", "SYS_MODULE", "NET_ADMIN", "NET_RAW", "SYS_RAWIO", "DAC_OVERRIDE", "CAP_SYS_ADMIN"]
CONTAINER_MOUNTS = ["/proc", "/dev", "/sys", "/boot", "/etc", "/root", "/var/run/docker.sock", "docker.sock", "/host"]
PROCESS_KEYWORDS = [
    "nc ", "netcat", "bash -i", "perl ", "python ", "php ", "curl ", "wget ", "nmap", "xmrig", "crypto", "miner", "reverse", "revsh", "socat", "pty.spawn",
    "shell", "sudo su", "dropbear", "kworker", "crontab",
]
PUBLIC_RESOLVERS = ["8.8.8.8", "8.8.4.4", "1.1.1.1", "9.9.9.9"]
RANK1 = [
    "reverse shell", "bash -i", "netcat", "execve=", "insmod", "modprobe", "chattr", "kernel panic", "segfault", "selinux denial", "failed root login",
]
RANK2 = ["wget", "curl", "base64", "new user", "scp", "rsync", "unknown login", "potential backdoor"]
RANK_WHITELIST = ["/var/log/", "/opt/CrowdStrike/", "/usr/", "/lib"]


def quoted(word: str) -> str:
    return re.sub(r"([^A-Za-z0-9 /_%<>'@&~,:;=#\"!-])", r"\\\1", word)


def either(a: Column, b: Column) -> Column:
    return a | b


def alternation(words: list[str]) -> str:
    """A pattern that is found where any of the words is: words of one beginning share it, and a place in the text is
    left after one test of its character if no word begins so. A plain alternation tries every word at every place."""
    if "" in words:
        return ""
    first = {}
    for w in words:
        first.setdefault(w[0], []).append(w[1:])
    rest = {c: alternation(ws) for c, ws in first.items()}
    one = "|".join(quoted(c) + (f"(?:{r})" if "|" in r else r) for c, r in rest.items())
    return one if len(first) == 1 else f"(?=[{''.join(re.escape(c) for c in first)}])(?:{one})"


def contains_any(text: Column, words: list[str]) -> Column:
    """Whether any of the words occurs, letter case aside: one alternation, one pass over the text."""
    return F.lower(text).rlike(alternation([w.lower() for w in words]))


def first_match(text: Column, words: list[str]) -> Column:
    """The first word of the list that occurs, letter case aside; null if none. The alternation spares most lines the list."""
    return let(F.lower(text), lambda low: first_word(low, words))


def first_word(low: Column, words: list[str]) -> Column:
    """first_match of a text that is at hand in small letters, which is written out for every word."""
    return F.when(low.rlike(alternation([w.lower() for w in words])), F.coalesce(*[F.when(low.contains(w.lower()), F.lit(w)) for w in words]))


def matches_any(text: Column, patterns: list[str]) -> Column:
    """Like contains_any, for words that are patterns. If each begins with a letter that must be there, a place in the text
    is left after one test of its character."""
    either_of = "|".join(f"(?:{p})" for p in patterns)
    plain = all(re.match(r"[a-z](?![?*{])[^|]*$", p) for p in patterns)
    return F.lower(text).rlike(f"(?=[{''.join(sorted({p[0] for p in patterns}))}])(?:{either_of})" if plain else either_of)


def starts_with_any(text: Column, prefixes: list[str]) -> Column:
    """Prefix test, letter case aside on both sides."""
    low = F.lower(text)
    return reduce(either, [low.startswith(p.lower()) for p in prefixes])


def classify_severity(text: Column, mapping: dict[str, str]) -> Column:
    """Severity of the first keyword found, keywords tried by severity name descending; else Info."""
    out = F.lit("Info")
    for word, severity in reversed(sorted(mapping.items(), key=lambda x: x[1], reverse=True)):
        out = F.when(F.lower(text).contains(word.lower()), severity).otherwise(out)
    return out
