"""Labelled training excerpts for the credential labeller, from public formats.

Every form is a documented format of a public tool or standard (named beside it) or
a common idiom of a programming language, with names and values made up by rule.
The tests hold out whole forms that never occur here.
"""

from __future__ import annotations

import base64
import random
import string
from collections.abc import Callable
from urllib.parse import quote as percent

_ALNUM = string.ascii_letters + string.digits
_HEX = "0123456789abcdef"
_ONSET = "b br c ch d dr f fl g gr h j k l m n p pl r s sl st t tr v w z".split()
_NUCLEUS = "a e i o u ai ea oo ou".split()
_CODA = "n r l s t m k nd rt ck x".split()


class Generator:
    """Labelled excerpts: text with the secrets between two marks."""

    A, Z = "\ue000", "\ue001"

    def __init__(self, seed: int) -> None:
        self.r = random.Random(seed)

    # -------------------------------------------------------------- values

    def chars(self, n: int, of: str = _ALNUM) -> str:
        return "".join(self.r.choice(of) for _ in range(n))

    def hex(self, n: int) -> str:
        return self.chars(n, _HEX)

    def word(self) -> str:
        """A made-up word."""
        r = self.r
        return "".join(r.choice(_ONSET) + r.choice(_NUCLEUS) for _ in range(r.choice((1, 1, 2)))) + r.choice(_CODA)

    def name(self) -> str:
        """A made-up identifier in one of the usual cases."""
        r = self.r
        a, b = self.word(), r.choice([self.word(), r.choice("list item id name value state count info index group type item result config user data".split())])
        return r.choice([a, a, f"{a}_{b}", f"{a}{b.capitalize()}", f"{a.capitalize()}{b.capitalize()}"])

    def host(self) -> str:
        r = self.r
        return r.choice([f"{self.word()}{r.randint(1, 20)}.{self.word()}.{r.choice(['example.com', 'internal', 'lan', 'io', 'net', 'test', 'invalid', 'example'])}", f"{self.word()}.{r.choice(['example.org', 'local', 'dev', 'example', 'invalid'])}", "localhost", "127.0.0.1", f"10.{r.randint(0, 255)}.{r.randint(0, 255)}.{r.randint(1, 254)}"])

    def password(self) -> str:
        r = self.r
        k = r.randrange(8)
        if k == 0:
            return r.choice("-- _.").join(self.word() for _ in range(r.choice((3, 4, 4, 5)))).replace(" ", "-")
        if k in (1, 2, 3):
            w = self.word()
            return (w.capitalize() if r.random() < 0.5 else w) + r.choice(["", "-", "_", "!", ".", "@", "#"]) + self.chars(r.randint(2, 6), string.digits) + r.choice(["", "", "!", "#", "%", "$"])
        if k == 4:
            return self.chars(r.randint(8, 16), _ALNUM + "!#%&*$+^~")
        return self.chars(r.randint(8, 24), r.choice([_ALNUM, _ALNUM, string.ascii_letters, string.ascii_lowercase + string.digits])) + r.choice(["", "", "!", "#", "_", "%"])

    def jwt(self) -> str:
        enc = lambda s: base64.urlsafe_b64encode(s.encode()).decode().rstrip("=")
        return enc('{"alg":"HS256","typ":"JWT"}') + "." + enc('{"sub":"%s","exp":%d}' % (self.word(), self.r.randint(10**9, 2 * 10**9))) + "." + self.chars(43, _ALNUM + "-_")

    def issued(self) -> str:
        """Keys and tokens by their issuers' published formats, and bare ones."""
        r, x = self.r, self.chars
        return r.choice(
            [
                lambda: r.choice(["ghp_", "gho_", "ghu_", "ghs_", "ghr_"]) + x(36),
                lambda: "github_pat_" + x(22) + "_" + x(59),
                lambda: r.choice(["sk-proj-", "sk-ant-", "sk-"]) + x(40),
                lambda: r.choice(["AKIA", "ASIA"]) + x(16, string.ascii_uppercase + string.digits),
                lambda: "glpat-" + x(20),
                lambda: r.choice(["xoxb-", "xoxp-", "xapp-1-"]) + x(12, string.digits) + "-" + x(24),
                lambda: "AIza" + x(35, _ALNUM + "-_"),
                lambda: r.choice(["sk_live_", "rk_live_", "whsec_"]) + x(24),
                self.jwt,
                lambda: r.choice(["npm_", "hf_", "dop_v1_", "pypi-"]) + x(36),
                lambda: "SG." + x(22) + "." + x(43),
                lambda: "shpat_" + self.hex(32),
                lambda: "key-" + self.hex(32),
                lambda: "AC" + self.hex(32) if False else "SK" + self.hex(32),
                lambda: x(r.randint(2, 5), string.ascii_lowercase) + r.choice("_-") + x(r.randint(20, 36)),
                lambda: x(r.randint(2, 5), string.ascii_lowercase) + "-" + self.hex(8) + "-" + x(16),
                lambda: x(r.randint(20, 44)),
                lambda: x(r.randint(20, 44)),
                lambda: self.hex(r.choice((32, 40, 48, 64))),
                lambda: x(r.randint(24, 40), _ALNUM + "-_"),
                lambda: "-".join(x(5, string.ascii_uppercase + string.digits) for _ in range(r.choice((4, 5)))),
            ]
        )()

    def key64(self) -> str:
        r = self.r
        n = r.choice((43, 86, 64))
        return self.chars(n, _ALNUM + "+/") + {43: "=", 86: "==", 64: ""}[n]

    def b64(self, s: str) -> str:
        return base64.b64encode(s.encode()).decode()

    def pem(self, what: str, nl: str = "\n", closed: bool = True) -> str:
        lines = [self.chars(64, _ALNUM + "+/") for _ in range(self.r.randint(1, 5))] + [self.chars(self.r.randint(20, 60), _ALNUM + "+/")]
        body = nl.join(self.A + x + self.Z if "PRIVATE" in what else x for x in lines)
        return f"-----BEGIN {what}-----{nl}{body}" + (f"{nl}-----END {what}-----" if closed else "")

    def key_name(self) -> str:
        r = self.r
        k = r.choice("password passwd pwd pass secret token api_key apikey access_key secret_key client_secret auth_token access_token refresh_token private_key encryption_key signing_key passphrase master_password bearer_token credentials kennwort passwort contraseña mot_de_passe clave license_key webhook_secret shared_secret psk".split())
        if r.random() < 0.35:
            k = f"{self.word()}_{k}"
        return r.choice([str, str.upper, lambda s: "".join(p.capitalize() if i else p for i, p in enumerate(s.split("_"))), lambda s: s.replace("_", "-"), lambda s: s.replace("_", "."), lambda s: "".join(p.capitalize() for p in s.split("_"))])(k)

    # -------------------------------------------------------------- forms

    def good_forms(self) -> list[Callable[[], str]]:
        r = self.r
        s = lambda x: self.A + x + self.Z
        p, t = self.password(), self.issued()
        v = r.choice([p, t])
        n, m, h = self.name(), self.word(), self.host()
        u = r.choice(["root", "admin", "ops", "service", "jenkins", "postgres", self.word(), self.word()])
        q = r.choice(["'", '"'])
        k = self.key_name()
        port = r.choice((5432, 3306, 6379, 27017, 5672, 1433))
        scheme = r.choice(["postgresql", "postgres", "mysql", "amqp", "amqps", "redis", "rediss", "mongodb", "mongodb+srv", "https", "http", "ftp", "sftp", "smtp", "ldap", "mssql+pyodbc", "clickhouse"])
        cut = r.randint(4, max(5, len(t) - 4))
        mid = r.randint(2, cut - 1)
        env = r.choice([k.upper().replace("-", "_").replace(".", "_"), f"{m.upper()}_{r.choice(['KEY', 'SECRET', 'TOKEN', 'PASS', 'PASSWORD', 'AUTH', 'PAT', 'CREDENTIAL'])}"])
        secs = r.choice(["AES", "HMAC", "JWT", "SIGNING", "ENCRYPTION", "SESSION"])
        return [
            # assignments in programming languages and flat files
            lambda: f"{k} = {q}{s(v)}{q}",
            lambda: f"{k}: {s(v)}",
            lambda: f"{k}: {q}{s(v)}{q}",
            lambda: f"{k}={s(v)}",
            lambda: f'"{k}": "{s(v)}"',
            lambda: f'"{k}": "{s(v)}",\n"{n}": {r.randint(1, 99)}',
            lambda: f"const {r.choice([k.replace('-', '_').replace('.', '_'), 't', 'k', n])} = {q}{s(t)}{q};",
            lambda: f"{r.choice(['let', 'var', 'final String', 'private static final String', 'public const string', 'static const char *'])} {r.choice([k.replace('-', '_').replace('.', '_'), secs + '_KEY', secs])} = \"{s(v)}\";",
            lambda: f"{r.choice(['var', 'const'])} {n} = []byte(\"{s(r.choice([self.key64(), t]))}\")",
            lambda: f"{r.choice(['x', 'a', 'v', 'tmp', n])} {r.choice(['=', ':='])} {q}{s(t)}{q}",
            lambda: f"return {q}{s(t)}{q}",
            lambda: f"{n}({q}{s(t)}{q})",
            lambda: f"{n}.{r.choice(['auth', 'login', 'connect', 'authenticate', 'setPassword', 'with_token'])}({q}{u}{q}, {q}{s(p)}{q})",
            lambda: f"{n}({r.choice(['user', 'username'])}={q}{u}{q}, {r.choice(['password', 'passwd', 'pwd', 'secret', 'api_key', 'token'])}={q}{s(v)}{q}, {r.choice(['timeout', 'port'])}={r.randint(1, 9000)})",
            lambda: f"{r.choice(['auth', 'credentials', 'creds', 'login'])} = ({q}{u}{q}, {q}{s(p)}{q})",
            lambda: f"{n} = {q}{s(t[:cut])}{q} + {q}{s(t[cut:])}{q}",
            lambda: f"{n} = {q}{s(t[:mid])}{q} + {q}{s(t[mid:cut])}{q} + {q}{s(t[cut:])}{q}",
            lambda: f"{n} = ({q}{s(t[:cut])}{q}\n    {q}{s(t[cut:])}{q})",
            lambda: f"{n} = os.environ.get({q}{env}{q}, {q}{s(v)}{q})",
            lambda: f"{n} = os.getenv({q}{env}{q}, {q}{s(v)}{q})",
            lambda: f"{n} = process.env.{env} || {q}{s(v)}{q}",
            lambda: f"{n}: ${{{env}:-{s(v)}}}",
            lambda: f"{n} = ENV.fetch({q}{env}{q}, {q}{s(v)}{q})",
            # environment files, Dockerfiles, shells
            lambda: f"{r.choice(['export ', '', 'ENV ', 'ARG ', 'set ', 'SET '])}{env}={s(v)}",
            lambda: f"{r.choice(['export ', ''])}{env}={q}{s(v)}{q}",
            lambda: f"RUN {r.choice(['npm config set //registry.npmjs.org/:_authToken', 'git config --global gitlab.token'])} {s(t)}",
            lambda: f"- {env}={s(v)}",
            # header fields: RFC 7617 Basic, RFC 6750 Bearer, and custom ones
            lambda: f"Authorization: Basic {s(self.b64(u + ':' + p))}",
            lambda: f"{r.choice(['headers', n])} = {{{q}Authorization{q}: {q}Basic {s(self.b64(u + ':' + p))}{q}}}",
            lambda: f"{r.choice(['curl', 'http', 'wget'])} {r.choice(['-H', '--header'])} {q}Authorization: {r.choice(['Bearer', 'Bearer', 'token', 'Token'])} {s(t)}{q} https://{h}/{m}",
            lambda: f"{r.choice(['headers', n])} = {{{q}{r.choice(['X-Api-Key', 'X-Auth-Token', 'Authorization', 'PRIVATE-TOKEN', 'Ocp-Apim-Subscription-Key', 'X-Vault-Token', 'x-functions-key'])}{q}: {q}{s(t)}{q}}}",
            lambda: f"-H {q}{r.choice(['X-Api-Key', 'PRIVATE-TOKEN', 'X-Vault-Token', 'X-Auth-Token'])}: {s(t)}{q}",
            lambda: f"Cookie: {r.choice(['session', 'sid', 'auth', 'JSESSIONID'])}={s(r.choice([self.jwt(), t]))}; Path=/",
            lambda: f"{r.choice(['localStorage', 'sessionStorage'])}.setItem({q}{r.choice(['token', 'access', 'id_token', 'jwt', 'auth', 'session'])}{q}, {q}{s(r.choice([self.jwt(), t]))}{q})",
            # userinfo of addresses (RFC 3986) and query parameters
            lambda: f"{r.choice([env + '=', n + ': ', 'url = ' + q, '', 'git remote add origin ', 'git clone ', 'pip install -i ', 'jdbc:'])}{scheme}://{u}:{s(r.choice([p.replace('#', '').replace('@', '').replace('%', ''), t, percent(p, safe='')]))}@{h}:{port}/{m}",
            lambda: f"{r.choice(['', 'git clone ', 'url: ', '  url = '])}https://{s(t)}@{h}/{m}/{m}.git",
            lambda: f"{r.choice(['git clone ', 'origin '])}https://{r.choice([u, 'oauth2', 'x-access-token', 'x-token-auth'])}:{s(t)}@{h}/{m}/{self.word()}.git",
            lambda: f"{scheme}://:{s(r.choice([t, self.chars(14)]))}@{h}:{port}/0",
            lambda: f"{r.choice(['curl', 'curl -s', 'GET', 'wget', ''])} https://{h}/{m}?{r.choice(['key', 'k', 'token', 'access_token', 'api_key', 'apikey', 'sig', 'auth'])}={s(t)}{r.choice(['', '&page=2', ' -o out.json'])}",
            lambda: f"https://{r.choice(['hooks', 'webhook', 'notify'])}.{m}.com/services/T{self.chars(8, string.ascii_uppercase + string.digits)}/B{self.chars(8, string.ascii_uppercase + string.digits)}/{s(self.chars(24))}",
            lambda: f"{r.choice(['webhook', 'url', 'hook', 'WEBHOOK_URL'])}{r.choice(['=', ': '])}https://{h}/api/webhooks/{self.chars(18, string.digits)}/{s(self.chars(r.randint(32, 68), _ALNUM + '-_'))}",
            lambda: f"https://api.{m}.org/bot{self.chars(9, string.digits)}:{s(self.chars(35, _ALNUM + '-_'))}/sendMessage",
            # client tools, from their manual pages
            lambda: f"curl {r.choice(['-u', '--user'])} {u}:{s(p)} {r.choice(['-X POST ', ''])}https://{h}/{m}",
            lambda: f"{r.choice(['mysql', 'mysqldump', 'mariadb', 'mysqladmin'])} -u{r.choice(['', ' '])}{u} -p{s(self.chars(r.randint(7, 16)))} -h {h} {m}",
            lambda: f"{r.choice(['mysql', 'psql', 'mongosh', 'mongodump', 'sqlcmd', 'ldapsearch', 'kinit', 'docker login', 'helm registry login', 'svn checkout'])} --user{r.choice(['name', ''])} {u} --password{r.choice([' ', '='])}{s(p)} {h}",
            lambda: f"sshpass -p {s(p)} {r.choice(['ssh', 'scp', 'rsync', 'sftp'])} {u}@{h}",
            lambda: f"sshpass -p {q}{s(p)}{q} {r.choice(['ssh', 'scp', 'rsync'])} {u}@{h}",
            lambda: f"{r.choice(['ldapsearch -x -D cn=' + u + ' -w', 'sqlcmd -S ' + h + ' -U ' + u + ' -P', 'docker login -u ' + u + ' -p', 'redis-cli -h ' + h + ' -a', 'smbclient -U ' + u + ' --password', 'ftp -u ' + u + ' -w', 'az login -u ' + u + ' -p', 'cqlsh -u ' + u + ' -p', 'mongo -u ' + u + ' -p', 'vault login', 'keytool -genkey -storepass', 'zip -P', '7z a -p', 'htpasswd -b .htpasswd ' + u])} {s(p)} {r.choice(['', m, '--quiet'])}".rstrip(),
            lambda: f"PGPASSWORD={r.choice(['', q])}{s(self.chars(r.randint(8, 16)))} psql -U {u} -h {h}",
            lambda: f"openssl {r.choice(['enc', 'rsa', 'pkcs12'])} -in {m}.pem -{r.choice(['passin', 'passout', 'pass'])} pass:{s(p)}",
            lambda: f"echo {q}{s(p)}{q} | {r.choice(['sudo -S ls', 'passwd --stdin ' + u, 'docker login --password-stdin -u ' + u])}",
            # credential files: netrc, pgpass, git-credentials, npmrc, pypirc, htpasswd-less tools
            lambda: f"machine {h} login {u} password {s(p)}",
            lambda: f"machine {h}\n  login {u}\n  password {s(p)}",
            lambda: f"{h}:{port}:{m}:{u}:{s(p.replace(':', ''))}",
            lambda: f"//registry.{m}.org/:_authToken={s(t)}",
            lambda: f"_auth={s(self.b64(u + ':' + p))}",
            lambda: f"[{m}]\nusername = {u}\npassword = {s(v)}",
            lambda: f"[default]\naws_access_key_id = {s('AKIA' + self.chars(16, string.ascii_uppercase + string.digits))}\naws_secret_access_key = {s(self.chars(40, _ALNUM + '+/'))}",
            lambda: f"network={{\n  ssid=\"{m}\"\n  psk=\"{s(p)}\"\n}}",
            lambda: f"[Interface]\nPrivateKey = {s(self.chars(43, _ALNUM + '+/') + '=')}\nAddress = 10.0.0.2/24",
            lambda: f"{u}:{s(p.replace(':', ''))}\n{self.word()}:{s(self.chars(12))}",
            # databases
            lambda: f"{r.choice(['CREATE', 'ALTER'])} USER {u} IDENTIFIED BY '{s(p)}'",
            lambda: f"{r.choice(['CREATE ROLE', 'ALTER USER', 'ALTER ROLE', 'CREATE USER'])} {u} WITH {r.choice(['LOGIN ', 'ENCRYPTED ', ''])}PASSWORD '{s(p)}';",
            lambda: f"SET PASSWORD FOR '{u}'@'{h}' = PASSWORD('{s(p)}');",
            lambda: f"INSERT INTO {m} (login, password) VALUES ('{u}', '{s(p)}');",
            lambda: f"{r.choice(['Server', 'Data Source', 'Host', 'Driver={{PostgreSQL}};Server'])}={h};{r.choice(['Database', 'Initial Catalog'])}={m};{r.choice(['User Id', 'UID', 'Username', 'User'])}={u};{r.choice(['Password', 'Pwd', 'PWD'])}={s(p.replace(';', ''))};{r.choice(['', 'Encrypt=true', 'SslMode=Require;'])}",
            lambda: f"DefaultEndpointsProtocol=https;AccountName={m};AccountKey={s(self.chars(86, _ALNUM + '+/') + '==')};EndpointSuffix=core.{m}.net",
            lambda: f"Endpoint=sb://{h}/;SharedAccessKeyName={self.word()};SharedAccessKey={s(self.chars(43, _ALNUM + '+/') + '=')}",
            # configuration: properties, YAML, XML, HCL, JSON
            lambda: f"{m}.{r.choice(['datasource', 'mail', 'redis', 'ldap', 'rabbitmq', 'security.user'])}.{r.choice(['password', 'secret', 'api-key', 'token'])}={s(v)}\n{m}.{self.word()}={r.randint(1, 9999)}",
            lambda: f"{m}:\n  {r.choice(['host', 'url', 'server'])}: {h}\n  {r.choice(['username', 'user', 'login'])}: {u}\n  {r.choice(['password', 'secret', 'token', 'pass'])}: {s(v)}",
            lambda: f"apiVersion: v1\nkind: Secret\nmetadata:\n  name: {m}\n{r.choice(['data', 'data', 'stringData'])}:\n  {r.choice(['password', 'token', 'tls.key', 'key', 'apikey', m])}: {s(self.b64(v))}",
            lambda: f"kind: Secret\n{r.choice(['data', 'stringData'])}:\n  {r.choice(['password', 'token', 'key'])}: {s(self.b64(p))}",
            lambda: f"<{r.choice(['server', 'datasource', 'user'])}><id>{m}</id><username>{u}</username><{(x := r.choice(['password', 'passphrase', 'secret', 'token']))}>{s(v)}</{x}></{m}>",
            lambda: f"<{(x := r.choice(['password', 'passphrase', 'secret', 'apiKey']))}>{s(v)}</{x}>",
            lambda: f"<{r.choice(['add', 'property', 'entry', 'param', 'setting'])} {r.choice(['key', 'name'])}=\"{r.choice([k, 'ApiKey', 'Password', 'Secret', 'hibernate.connection.password'])}\" value=\"{s(v)}\"{r.choice(['/', ' /'])}>",
            lambda: f"resource \"{m}_{self.word()}\" \"{self.word()}\" {{\n  {r.choice(['username', 'name'])} = \"{u}\"\n  {r.choice(['password', 'master_password', 'secret', 'admin_password', 'token'])} = \"{s(v)}\"\n}}",
            lambda: f"variable \"{r.choice(['db_password', 'api_token', k])}\" {{\n  default = \"{s(v)}\"\n}}",
            lambda: f"{{\"auths\": {{\"{h}\": {{\"auth\": \"{s(self.b64(u + ':' + p))}\"}}}}}}",
            lambda: f"{{\"{r.choice(['endpoint', 'url', 'host'])}\": \"https://{h}\", \"{r.choice(['apiKey', 'token', 'secret', 'password', 'accessToken'])}\": \"{s(v)}\", \"{self.word()}\": {r.randint(1, 99)}}}",
            lambda: f"{{\"type\": \"service_account\", \"private_key_id\": \"{self.hex(40)}\", \"private_key\": \"{self.pem('PRIVATE KEY', chr(92) + 'n')}\\n\"}}",
            lambda: f"users:\n- name: {u}\n  user:\n    {r.choice(['token', 'password', 'client-key-data'])}: {s(r.choice([self.jwt(), v]))}",
            lambda: f"define('{r.choice(['DB_PASSWORD', 'AUTH_KEY', 'SECURE_AUTH_KEY', 'NONCE_SALT', 'LOGGED_IN_KEY'])}', '{s(self.chars(r.randint(12, 40)))}');",
            lambda: f"$config['{r.choice(['password', 'secret', 'encryption_key'])}'] = '{s(v)}';",
            lambda: f"'{r.choice(['password', 'secret', 'key', 'token', 'apikey'])}' => '{s(v)}',",
            lambda: f"config.{r.choice(['secret_key_base', 'secret_token', 'pepper'])} = '{s(self.hex(r.choice((64, 128))))}'",
            lambda: f"SECRET_KEY = '{s(self.chars(50, _ALNUM + '!@#%^&*(-_=+'))}'".replace("(", "x"),
            # diffs, logs, notes
            lambda: f"{r.choice(['+', '-'])}{r.choice(['  ', ' ', ''])}{k}{r.choice([': ', ' = ', '='])}{r.choice(['', q])}{s(v)}",
            lambda: f"-  {k}: \"${{{env}}}\"\n+  {k}: \"{s(v)}\"",
            lambda: f"{r.choice(['#', '//', '--', ';'])} {r.choice(['previous', 'legacy', 'backup', 'former', 'expired', 'spare', 'staging', 'second'])}{r.choice([' key', ' token', '', ' one', ' value'])}: {r.choice(['', q])}{s(t)}",
            lambda: f"{r.choice(['#', '//', '/*', '--'])} {r.choice(['account', 'credentials', 'access', 'sign-in', 'user'])} {r.choice(['for ' + m + ' ', 'on ' + h + ' ', ''])}{r.choice(['is', 'are', '='])} {u} / {s(p)}",
            lambda: f"{r.choice(['#', '//', '*', '-', ''])} {u} / {s(p)} {r.choice(['', '(' + m + ')', 'on ' + h, ', see ' + m])}",
            lambda: f"{r.choice(['The', 'Its', 'Our', 'New', 'My', 'temp', 'the'])} {r.choice(['password', 'pass phrase', 'passphrase', 'pin', 'API key', 'token', 'wifi password', 'root password', 'secret'])} {r.choice(['is', 'is now', 'was', 'for ' + m + ' is', 'became', 'changed to', '='])} {r.choice(['', '`', q])}{s(v)}{r.choice(['', '.', ''])}",
            lambda: f"{r.choice(['Passwort', 'Kennwort', 'Mot de passe', 'Contraseña', 'wachtwoord', '密码', '密碼', 'パスワード', '비밀번호', 'Zugangsdaten', 'PIN', 'pw', 'pass', 'Schlüssel', 'clé', 'clave'])}{r.choice([': ', ' = ', ' ist ', ' : ', ' lautet ', ' est ', '：', ' / '])}{s(p)}",
            lambda: f"{r.choice(['[scan]', '[photo]', '(note)', '[ocr]', 'whiteboard', 'sticker'])} {r.choice(['guest network', 'WLAN', 'hotspot', 'server room', 'admin page', 'safe'])} {r.choice(['/', '-', '|', ':'])} {r.choice(['passphrase', 'password', 'code', 'key', 'pass', 'pw', 'PIN'])}{r.choice([': ', ' = ', ' '])}{s(p)}",
            lambda: f"{r.choice(['login', 'user', 'username', 'account'])}: {u}{r.choice([', ', ' ', chr(10), ' / '])}{r.choice(['password', 'pass', 'pw', 'pwd'])}: {s(p)}",
            lambda: f"{r.choice(['DEBUG', 'INFO', 'WARN', 'ERROR'])} {r.choice(['login with', 'connecting using', 'sent', 'using'])} {r.choice(['password', 'token', 'key', 'secret', 'credentials'])}{r.choice([' ', '=', ': '])}{s(v)}",
            # private keys: RFC 7468 and the OpenSSH format
            lambda: self.pem(r.choice(["RSA PRIVATE KEY", "PRIVATE KEY", "EC PRIVATE KEY", "OPENSSH PRIVATE KEY", "ENCRYPTED PRIVATE KEY", "DSA PRIVATE KEY"]), closed=r.random() < 0.7),
            lambda: f"{r.choice([k, 'key', 'pem', 'private', 'tls_key'])}: |\n  " + self.pem(r.choice(["RSA PRIVATE KEY", "PRIVATE KEY", "OPENSSH PRIVATE KEY"]), "\n  ", r.random() < 0.7),
            lambda: f'"{r.choice(["private", "key", "private_key", "pem", "cert_key"])}": "' + self.pem(r.choice(["RSA PRIVATE KEY", "PRIVATE KEY", "EC PRIVATE KEY"]), "\\n", r.random() < 0.6) + '"',
            lambda: f"{n} = {q}{q}{q}" + self.pem("RSA PRIVATE KEY") + f"{q}{q}{q}",
        ]

    def bad_forms(self) -> list[Callable[[], str]]:
        r = self.r
        n, m, w, h = self.name(), self.word(), self.word(), self.host()
        k = self.key_name()
        plain = r.choice("password passwd secret token api_key apiKey client_secret auth_token credentials passphrase".split())
        env = f"{m.upper()}_{r.choice(['PASSWORD', 'TOKEN', 'SECRET', 'API_KEY'])}"
        q = r.choice(["'", '"'])
        holder = r.choice(
            [
                "changeme", "change-me", "CHANGEIT", "REPLACE_ME", "<your-api-key>", "<password>", "<token>", "{{ " + m + "_key }}", "{{" + m + "}}", "...", "YOUR_KEY_HERE", "your-token-here", "xxxxxxxx", "XXXXXXXXXXXX", "********", "*****", "••••••••",
                "[REDACTED]", "[masked]", "<redacted>", "null", "None", "none", "''", '""', "true", "false", "example", "placeholder", "TODO", "dummy", "xxx", "${TOKEN}", "${" + m.upper() + "}", "$" + m.upper(), "%(password)s", "%PASSWORD%", "#{" + m + "}", "@" + m + "@",
                "sk-" + "x" * 20, "ghp_" + "*" * 12, "AKIA" + "X" * 16, "AKIA...[hidden]", "glpat-" + "x" * 20, "sk_live_...", "<secret_" + str(r.randint(1, 9)) + ">", "not-set", "unset", "n/a", "insert-here", "fill_in", "enter password",
            ]
        )
        image = self.chars(r.randint(60, 160), _ALNUM + "+/")
        return [
            # placeholders, masks, empty values
            lambda: f"{k}: {holder}",
            lambda: f"{k} = {q}{holder}{q}",
            lambda: f"{k}={holder}",
            lambda: f'"{k}": "{holder}"',
            lambda: f"{r.choice(['curl -u', 'mysql -u', 'login'])} {m} {r.choice(['-p', ''])} {holder}",
            lambda: f"Authorization: {r.choice(['Bearer', 'Basic'])} {r.choice([holder, '<token>', '$TOKEN', '${TOKEN}', '{token}'])}",
            # references: environment, stores, attributes, calls
            lambda: f"{k.replace('-', '_').replace('.', '_')} = os.environ[{q}{env}{q}]",
            lambda: f"{plain} = {r.choice(['os.getenv', 'getenv', 'System.getenv', 'os.environ.get', 'env', 'config.get', 'settings.get', 'vault.read', 'Secret.load', 'keyring.get_password', 'getpass.getpass'])}({q}{r.choice([env, m, m + '.' + w])}{q})",
            lambda: f"{plain} = process.env.{env}",
            lambda: f"{plain} = {r.choice(['settings', 'config', 'self', 'ctx', 'this', 'app', 'args', 'request', 'props'])}.{m}.{plain}",
            lambda: f"{plain} = {r.choice(['get', 'read', 'load', 'fetch', 'derive', 'make', 'hash'])}_{plain.lower()}({m}, {w})",
            lambda: f"{n}({plain}={plain}, {m}={w})",
            lambda: f"{r.choice(['GH_TOKEN', 'TOKEN', 'API_KEY', env])}={r.choice(['$', '${'])}{m.upper()}_TOKEN" + r.choice(["", "}"]),
            lambda: f"{env}: ${{{{ secrets.{env} }}}}",
            lambda: f"{scheme}://{r.choice([':', m + ':'])}{r.choice(['${REDIS_PASSWORD}', '{password}', '$PASS', '%s', '<password>', '****'])}@{h}:6379/0" if (scheme := r.choice(["redis", "postgres", "amqp", "https"])) else "",
            lambda: f"{n} = f{q}{r.choice(['postgres', 'amqp', 'mysql', 'https'])}://{{user}}:{{{plain}}}@{{host}}/{m}{q}",
            lambda: f"{r.choice(['DATABASE_URL', 'BROKER_URL', 'url', m.upper() + '_URL'])}={r.choice(['postgres', 'mysql', 'amqp', 'redis', 'https', 'jdbc:mysql'])}://{h}:{r.randint(1000, 9999)}/{m}",
            lambda: f"{r.choice(['TOKEN_URL', 'token_endpoint', 'AUTH_URL', 'password_reset_url', 'PASSWORD_RESET', 'jwks_uri', 'secret_url'])}{r.choice(['=', ': '])}https://{h}/{r.choice(['oauth/token', 'auth/reset', 'v1/secrets', '.well-known/jwks.json', 'login'])}",
            lambda: f"{plain}: {r.choice(['vault:', 'vault://', 'op://', 'ssm:/', 'arn:aws:secretsmanager:eu-west-1:', 'gcp-sm://', 'file://', 'env:', 'azurekv://', 'secret/data/'])}{m}/{w}{r.choice(['', '#' + plain, '/' + plain])}",
            lambda: f"{r.choice(['secret_file', 'password_file', 'DB_PASSWORD_FILE', 'token_path', 'key_file', 'ssl_key', 'PRIVATE_KEY_PATH', 'credentials_file', 'IdentityFile', 'keystore', env + '_FILE', 'passwordFile'])}{r.choice(['=', ': ', ' = ', ' '])}{r.choice(['/run/secrets/', '/etc/ssl/private/', '~/.ssh/', '/var/lib/', './certs/', '/mnt/'])}{m}{r.choice(['', '.pem', '_key', '.key', '.json'])}",
            lambda: f"headers = {{{q}Authorization{q}: f{q}Bearer {{{r.choice(['token', 'self.token', 'access_token'])}}}{q}}}",
            lambda: f"valueFrom:\n  secretKeyRef:\n    name: {m}-{w}\n    key: {r.choice(['password', 'token', 'api-key'])}",
            lambda: f"secretName: {m}-{w}\nmountPath: /etc/{m}",
            lambda: f"{plain} = {r.choice(['var.', 'local.', 'data.vault.', 'module.'])}{m}_{r.choice(['password', 'token'])}",
            lambda: f"{plain} = {r.choice(['input', 'prompt', 'getpass', 'readline', 'ask'])}({q}{r.choice(['Password: ', 'Enter token: ', 'Passphrase? ', 'API key: '])}{q})",
            lambda: f"{r.choice(['read -sp', 'read -s -p', 'read -rp'])} {q}{r.choice(['Token: ', 'Secret: ', 'Passphrase: ', 'Enter password: '])}{q} {env}",
            lambda: f"echo {q}${env}{q} | {r.choice(['docker login --password-stdin', 'gh auth login --with-token'])}",
            # code that handles secrets
            lambda: f"{r.choice(['if', 'while', 'assert', 'unless', 'elif'])} {plain} {r.choice(['!=', '==', 'is', 'is not', 'in'])} {r.choice(['None', 'expected', 'stored', 'other.' + plain, 'confirm', n, 'null', 'allowed'])}:",
            lambda: f"if (!{plain}) {{ throw new Error({q}{r.choice(['missing ', 'no ', 'invalid ', 'empty '])}{plain}{q}); }}",
            lambda: f"def {m}_{plain.lower()}(self, {plain}: str, {w}: int = {r.randint(0, 9)}) -> {r.choice(['bool', 'str', 'None'])}:",
            lambda: f"{r.choice(['def', 'function', 'func', 'fn'])} {r.choice(['check', 'verify', 'rotate', 'hash', 'login', 'sign_in'])}_{w}({m}, {plain}{r.choice(['', '=None', ': string', '=' + m + '_' + plain])}):",
            lambda: f"{n} = {r.choice(['bcrypt', 'argon2', 'scrypt', 'pbkdf2', 'hashlib', 'hmac'])}.{r.choice(['hash', 'verify', 'check', 'compare', 'new'])}({plain}, {m})",
            lambda: f"{r.choice(['private', 'public', 'protected'])} {r.choice(['String', 'string', 'SecretKey', 'Token'])} {plain};",
            lambda: f"{plain}: {r.choice(['string', 'str', 'String', 'Optional[str]', 'z.string()', 'yup.string()', 'varchar(255)', 'text'])}{r.choice(['', ';', ',', ' | null'])}",
            lambda: f"{r.choice(['log', 'logger', 'console'])}.{r.choice(['info', 'debug', 'warn', 'log'])}({q}{r.choice(['token refreshed', 'password changed', 'no secret given', 'wrong password', 'key rotated'])}{q})",
            lambda: f"{n} = sorted({m}, key=lambda {r.choice(['token', 'key', 'x'])}: {r.choice(['token', 'key', 'x'])}.{w}, reverse=True)",
            lambda: f"{plain} = {r.choice(['request.headers.get', 'req.headers.get', 'req.get', 'cookies.get', 'params.fetch', 'form.get'])}({q}{r.choice(['X-Token', 'Authorization', 'password', 'X-Api-Key'])}{q})",
            lambda: f"for {r.choice(['token', 'key', 'secret'])} in {n}:\n    {m}.append({r.choice(['token', 'key', 'secret'])}.{w})",
            lambda: f"{r.choice(['password_field', 'PASSWORD_FIELD', 'token_label', 'key_column', 'SECRET_NAME', 'PASSWORD_KEY'])} = {q}{r.choice(['password', 'passwd', 'new_password', 'password2', 'token', 'secret', 'user.password'])}{q}",
            lambda: f"delete {n}.{plain};",
            # settings about secrets
            lambda: f"{r.choice(['password', 'token', 'secret', 'session'])}_{r.choice(['min_length', 'max_age', 'ttl', 'expiry_days', 'timeout', 'rotation', 'attempts', 'length', 'required', 'policy', 'type', 'algorithm', 'encoding'])}{r.choice([' = ', '=', ': '])}{r.choice([str(r.randint(1, 9000)), 'true', 'false', 'strict', 'sha256', 'bcrypt', '30d', 'utf-8', 'RS256'])}",
            lambda: f"{r.choice(['max_tokens', 'token_count', 'n_tokens', 'tokens_per_second', 'MAX_TOKENS', 'vocab_tokens', 'input_tokens'])}{r.choice(['=', ': ', ' = '])}{r.randint(10, 900000)}",
            lambda: f"{r.choice(['SESSION_COOKIE_NAME', 'CSRF_COOKIE', 'cookie_name', 'AUTH_HEADER', 'TOKEN_PREFIX', 'realm', 'KEY_PREFIX', 'tokenName', 'auth_scheme', 'key_id', 'KMS_KEY_ALIAS'])}{r.choice(['=', ': ', ' = '])}{r.choice([m + '_sid', m, 'Bearer', 'X-' + m.capitalize(), m + '-' + w, 'alias/' + m, m + '.' + w])}",
            lambda: f"{r.choice(['keyboard_shortcut', 'shortcut', 'hotkey', 'keymap', 'accelerator', 'key_binding', 'keys'])}{r.choice([': ', ' = ', '='])}{r.choice(['Ctrl', 'Cmd', 'Alt', 'Meta'])}+{r.choice(['Shift+', 'Alt+', ''])}{self.chars(1, string.ascii_uppercase)}",
            lambda: f"{r.choice(['primary_key', 'foreign_key', 'sort_key', 'cache_key', 'key', 'partition_key', 'group_key', 'keyword', 'keys'])}{r.choice([': ', ' = ', '='])}{r.choice(['', q])}{r.choice([n, m + '_id', m + ':' + w + ':' + str(r.randint(1, 99)), m + '.' + w])}",
            lambda: f"{r.choice(['ALTER TABLE', 'CREATE TABLE'])} {m} {r.choice(['ADD COLUMN ', '('])}{r.choice(['password_hash', 'password', 'token', 'secret_key', 'api_key'])} {r.choice(['varchar', 'char'])}({r.randint(20, 255)}){r.choice(['', ' not null', ';', ')'])}",
            lambda: f"GRANT SELECT ON {m}.* TO '{w}'@'%' {r.choice(['', 'IDENTIFIED VIA pam', 'REQUIRE SSL'])};",
            # sums, versions, identifiers
            lambda: f"{r.choice(['commit', 'revision', 'parent', 'Merge', 'ref', 'HEAD is now at', 'fixes', 'tree'])} {self.hex(r.choice((7, 12, 40)))} {r.choice(['touches', 'adds', 'drops', 'renames', ''])} {r.choice(['the token column', 'password form', m, 'the secret store', ''])}",
            lambda: f"{r.choice(['checksum', 'sha256', 'digest', 'md5', 'sum', 'hash', 'integrity', 'fingerprint', 'content_hash', 'etag'])}{r.choice([': ', '=', ' = '])}{r.choice(['', q])}{r.choice(['sha256:', 'md5:', '', 'sha1-'])}{self.hex(r.choice((32, 40, 64)))}",
            lambda: f"{r.choice(['integrity', 'resolved', 'shasum'])}{r.choice(['=', ': '])}\"sha{r.choice((256, 384, 512))}-{self.chars(r.choice((43, 64, 86)), _ALNUM + '+/')}{r.choice(['=', '==', ''])}\"",
            lambda: f"{m} v{r.randint(0, 9)}.{r.randint(0, 20)}.{r.randint(0, 9)} h1:{self.chars(43, _ALNUM + '+/')}=",
            lambda: f"{r.choice(['FROM', 'image:'])} {h}/{m}/{w}@sha256:{self.hex(64)}",
            lambda: f"{r.choice(['tenant_id', 'client_id', 'id', 'uuid', 'request_id', 'trace', 'correlation-id', 'subscription', 'guid', 'session_id', 'appId'])}{r.choice([': ', ' = ', '='])}{r.choice(['', q])}{self.hex(8)}-{self.hex(4)}-4{self.hex(3)}-a{self.hex(3)}-{self.hex(12)}",
            lambda: f"{r.choice([m + 'Id', m + '_id', '_id', 'objectId', 'span_id', m + '_sha', 'build', 'blob', 'cache', 'node'])}{r.choice([': ', ' = ', '='])}{r.choice(['', q])}{self.hex(r.choice((16, 24, 32, 40)))}",
            lambda: f"{r.choice(['version', 'VERSION', m + '_version'])}{r.choice([': ', ' = ', '='])}{q}{r.randint(0, 20)}.{r.randint(0, 30)}.{r.randint(0, 9)}{r.choice(['', '-rc1', '-beta.2', '+' + self.hex(7)])}{q}",
            lambda: f"{r.choice(['color', 'background', 'fill', '--accent', 'tokens'])}: {r.choice(['#' + self.hex(6), 'rgb(1, 2, 3)', 'var(--' + m + ')'])};",
            # public material
            lambda: f"{r.choice(['ssh-ed25519', 'ssh-rsa', 'ecdsa-sha2-nistp256'])} AAAA{self.chars(r.randint(60, 200), _ALNUM + '+/')} {m}@{w}",
            lambda: f"{h} ssh-ed25519 AAAA{self.chars(64, _ALNUM + '+/')}",
            lambda: self.pem(r.choice(["PUBLIC KEY", "CERTIFICATE", "CERTIFICATE REQUEST", "RSA PUBLIC KEY", "X509 CRL", "PGP PUBLIC KEY BLOCK", "PGP SIGNATURE"]), closed=r.random() < 0.8),
            lambda: f"[Peer]\nPublicKey = {self.chars(43, _ALNUM + '+/')}=\nAllowedIPs = 0.0.0.0/0",
            lambda: f"{r.choice(['public_key', 'publishable_key', 'pubkey', 'site_key', 'PUBLIC_KEY'])} = {q}{r.choice(['pk_live_' + self.chars(24), self.hex(64), 'age1' + self.chars(58, string.ascii_lowercase + string.digits)])}{q}",
            lambda: f"{r.choice(['if', 'return', 'assert'])} {m}.{r.choice(['startswith', 'startsWith', 'includes', 'contains', 'find'])}({q}-----BEGIN {r.choice(['PRIVATE KEY', 'RSA PRIVATE KEY', 'CERTIFICATE', 'OPENSSH PRIVATE KEY'])}-----{q})",
            lambda: f"{r.choice(['PEM', 'KEY_RE', 'HEAD', n])} = re.compile(r{q}-----BEGIN (?:EC |RSA )?PRIVATE KEY-----{q})",
            lambda: f"{r.choice(['PATTERN', 'TOKEN_RE', 'rule', 'regex'])}{r.choice([' = ', ': '])}{r.choice(['re.compile(r', ''])}{q}{r.choice(['gh[pousr]_[A-Za-z0-9]{36}', 'AKIA[0-9A-Z]{16}', 'sk-[a-zA-Z0-9]{20,}', 'xox[bp]-[0-9]+', 'glpat-[\\w-]{20}', 'eyJ[\\w-]+', '(?i)password.{0,5}='])}{q}{r.choice([')', ''])}",
            # images, text, markup
            lambda: f"{r.choice(['background: url(', 'src=', '<img src=', 'icon: '])}{r.choice(['', q])}data:image/{r.choice(['png', 'gif', 'svg+xml', 'jpeg', 'webp'])};base64,{image}{r.choice(['', q])}{r.choice([')', '', '>'])}",
            lambda: f"sourceMappingURL=data:application/json;base64,{image}",
            lambda: f"<label for=\"{r.choice(['password', 'token', 'pw'])}\">{r.choice(['Password', 'Passwort', 'Kennwort', 'Mot de passe', 'Contraseña', '密码', 'Your token'])}</label>",
            lambda: f"<input type=\"password\" name=\"{r.choice(['password', 'pwd', m])}\" placeholder=\"{r.choice(['Password', 'Enter your password', 'Secret'])}\" />",
            lambda: f"{r.choice(['login', 'auth', 'form', 'errors', 'label', 'i18n'])}.{r.choice(['password', 'token', 'secret'])}.{r.choice(['title', 'hint', 'forgot', 'reset', 'invalid', 'label'])}{r.choice(['=', ' = ', ': '])}{r.choice(['Forgotten your password?', 'Set a new password', 'Passwort vergessen', 'Mot de passe incorrect', 'The token has expired', 'Contraseña no válida', '重置密码', 'Choose a strong password', 'Password must not be empty'])}",
            lambda: r.choice(
                [
                    "A password needs at least ten characters and a digit.",
                    "Rotate every token after ninety days and revoke the old one.",
                    "Secrets belong into the vault, never into the repository.",
                    "Request an API key from the platform team before you start.",
                    "When the session token is missing, the server answers 401.",
                    "Das Kennwort muss regelmäßig geändert werden.",
                    "Le mot de passe est conservé sous forme hachée.",
                    "El token caduca a los quince minutos.",
                    "Passwords are hashed with a salt and are never logged.",
                    "Private keys stay on the machine that created them.",
                    "The parser splits the input into tokens and keeps each key.",
                    "Authentication is basic for now; a bearer scheme follows.",
                    f"The {m} reads its secret from the {w} at start.",
                    f"See {m} for the key of each {w}; the token is not stored.",
                ]
            ),
            lambda: f"{r.choice(['#', '//', '*'])} {r.choice(['the token is read from', 'password comes from', 'secret lives in', 'key is kept in', 'credentials are stored in', 'see the vault for the key of'])} {r.choice(['the vault', m, 'the environment', 'keychain', 'AWS SSM'])}",
            lambda: f"{r.choice(['mailto:', 'notify: ', 'owner = ', 'maintainer: ', 'contact=', 'email = ' + q])}{m}-{r.choice(['team', 'list', 'dev', 'ops'])}@{h}",
            lambda: f"{m}@{w}.{r.choice(['service', 'timer', 'socket'])}",
            lambda: f"git@{h}:{m}/{w}.git",
            lambda: f"{m}/{w}@{r.randint(1, 9)}.{r.randint(0, 30)}.{r.randint(0, 9)}",
            lambda: f"ssh {m}@{h} uptime",
            lambda: f"{m}://{h}:{r.randint(1000, 9999)}/{w}/{self.word()}",
            lambda: f"{r.choice(['user', 'username', 'login'])} = {q}{m}{q}\n{r.choice(['host', 'server'])} = {q}{h}{q}",
            lambda: f"{u}:x:{r.randint(100, 9999)}:{r.randint(100, 9999)}::/home/{u}:/bin/sh" if (u := m) else "",
            lambda: f"{m}:$2{r.choice('aby')}$12${self.chars(53, _ALNUM + './')}",
            lambda: f"export const {r.choice(['tokens', 'keys', 'secrets'])} = {{ {m}: {q}#{self.hex(6)}{q}, {w}: {r.randint(1, 99)} }}",
        ]

    def filler(self) -> str:
        """A line or two of code, configuration or notes that has nothing to do with secrets."""
        r = self.r
        a, b, c = self.name(), self.word(), self.name()
        return r.choice(
            [
                lambda: f"for {b} in {a}:\n    {c}({b}.{self.word()})",
                lambda: f"if {a} is {r.choice(['None', 'not None'])}:\n    {a} = {b}[{r.randint(0, 99)}]",
                lambda: f"assert {a}({r.randint(0, 99)}) == {b}",
                lambda: f"{r.choice(['const', 'let', 'var'])} {a} = {r.choice(['await ', 'new ', ''])}{c}({b});",
                lambda: f"if (!{b}) {{ {a}({r.randint(0, 99)}); }}",
                lambda: f"{b} = {a}({c}, {self.word()}={r.randint(0, 9999)})",
                lambda: f"{r.choice(['//', '#', '--', '*'])} {' '.join(self.word() for _ in range(r.randint(1, 6)))}",
                lambda: f"{a}.{self.word()}({c});",
                lambda: f"{r.choice(['TODO', 'NOTE', 'FIXME', ''])} {r.choice(['The', 'A', 'This', 'Every'])} {b} {r.choice(['keeps', 'takes', 'drops', 'needs', 'reads'])} {r.choice(['the', 'one', 'no'])} {self.word()} {r.choice(['first', 'twice', 'as it is', 'at the end'])}.".strip(),
                lambda: f"return {a}",
                lambda: f"import {b}",
                lambda: f"{a}: {r.choice(['true', 'false', str(r.randint(0, 9999)), b, self.host()])}",
                lambda: f"{str(r.randint(1, 9999))}",
                lambda: "",
            ]
        )()

    def example(self) -> tuple[str, list[tuple[int, int]]]:
        """(text, spans of secrets)."""
        r = self.r
        k = r.random()
        parts = [self.filler() for _ in range(r.choice((0, 0, 0, 1, 2, 3)))]
        parts.append(r.choice(self.good_forms())() if k < 0.5 else r.choice(self.bad_forms())() if k < 0.92 else self.filler())
        if r.random() < 0.2:
            parts.append(r.choice(self.bad_forms())())
        parts += [self.filler() for _ in range(r.choice((0, 0, 0, 1, 2, 3)))]
        text = "\n".join(parts)
        if r.random() < 0.15:
            text = f"{'/'.join(self.word() for _ in range(r.randint(1, 5)))}{r.choice(['_', '/'])}{self.chars(3).lower()}/{self.word()}.{r.choice(['py', 'ts', 'go', 'yml', 'tf', 'md', 'java', 'rb'])}:{r.randint(1, 900)}: " + text
        if r.random() < 0.2:
            text = r.choice(["    ", "\t", " "]) + text + r.choice(["", "  ", "\n"])
        if r.random() < 0.1:
            text = text.replace("\n", "\r\n")
        return unmark(text)


def unmark(text: str) -> tuple[str, list[tuple[int, int]]]:
    """The text without the marks, and the spans between them."""
    spans, clean, at, start = [], [], 0, 0
    for c in text:
        if c == Generator.A:
            start = at
        elif c == Generator.Z:
            spans.append((start, at))
        else:
            clean.append(c)
            at += 1
    return "".join(clean), spans
