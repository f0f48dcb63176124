"""Patterns of the residue detector: messages to the reader, filler and script notices, by language; page frame.

They hold for normalised segments (residue.py): lower case, one blank between words, no punctuation, ``0`` for numbers and identifiers. A
segment counts only if one pattern matches it from its first to its last word, so a sentence that merely begins like a message
is none. These lists are the last evidence; what repeats over hosts is learned from the corpus without them.
"""

from __future__ import annotations

#: Up to so many further words.
_FEW, _SOME = r"(?: [^ ]+){0,3}", r"(?: [^ ]+){0,6}"
_JS = r"(?:java ?script|scripts?|scripting|js|active scripting|client side scripts|0 scripts|javascript and cookies|java script and cookies)"
_PAGE = r"(?:page|link|runbook|document|note|file|resource|address|url|site|article|view|dashboard|content)"
_CODE = r"(?:page not found|not found|forbidden|unauthorized|bad request|bad gateway|gateway (?:time ?out|0)|internal server error|service (?:temporarily )?unavailable|too many requests|request time ?out|gone|access denied)"

#: A demand to allow scripts.
SCRIPT = [
    # en
    rf"(?:please )?(?:switch on|turn on|enable|activate|allow) {_JS}(?: (?:to|in|for|and) [^ ]+(?: [^ ]+){{0,6}})?",
    rf"you (?:need to|must|have to) (?:enable|allow|activate|turn on|switch on) {_JS}{_SOME}",
    rf"(?:this|the|our) [^ ]+{_FEW} (?:needs?|requires?|starts only once|(?:could|can) ?not start because|only works with|does not work without|doesn t work without|will not work without|relies on|runs only with) {_JS}{_SOME}",
    rf"(?:your browser s )?{_JS} (?:must be|is|are|appears to be|appear to be|seems? to be|has been|have been) (?:on|off|required|needed|switched off|turned off|disabled|blocked|not enabled|not available|unavailable|deactivated|inactive){_SOME}",
    rf"sorry [^ ]+(?: [^ ]+){{0,6}} (?:can t|cannot|can not|could not|couldn t) be (?:displayed|shown|opened|loaded|rendered) without {_JS}",
    rf"your browser (?:does not|doesn t|cannot|can t) (?:support|run|execute) {_JS}{_SOME}",
    rf"if nothing happens make sure that {_JS} (?:is|are) not blocked",
    r"(?:loading|please wait|just a moment|one moment)",
    rf"(?:this|it) (?:needs|requires) {_JS}{_SOME}",
    rf"some (?:parts|features|functions) of (?:this|the){_FEW} (?:will not|won t|may not|do not|don t|cannot) work(?: properly| correctly)?",
    rf"checking your browser(?: before{_FEW})?",
    rf"we (?:ve |have )?(?:noticed|detected|see) that {_JS} (?:is|are) (?:blocked|disabled|off|switched off|turned off|not enabled){_SOME}",
    rf"no {_JS} support(?: detected)?",
    rf"to (?:read|see|view|use|open) this {_PAGE} (?:activate|enable|allow|turn on|switch on) {_JS}{_SOME}",
    r"turn it on then (?:refresh|reload)",
    rf"(?:please )?switch to a (?:modern|newer|different|supported) browser{_SOME}",
    r"(?:this|your) browser (?:is not supported|is too old|is out of date|blocks scripts)",
    # de
    rf"(?:bitte )?(?:aktivieren|schalten|erlauben) sie (?:bitte )?(?:javascript|skripte|scripts){_SOME}",
    rf"(?:diese|die|dieses) [^ ]+ (?:benötigt|braucht|erfordert|funktioniert nur mit|setzt) (?:javascript|skripte?|scripts){_FEW}",
    rf"(?:javascript|skripte|scripts) (?:ist|sind|muss|müssen){_FEW} (?:deaktiviert|aktiviert|erforderlich|abgeschaltet|ausgeschaltet|blockiert|eingeschaltet|sein|werden)",
    rf"ihr browser (?:unterstützt|führt|blockiert)(?: derzeit)? (?:kein |keine )?(?:javascript|skripte?|scripts){_FEW}",
    # fr
    rf"(?:veuillez|merci d e?) ?(?:activer|autoriser) (?:javascript|les scripts|l exécution des? scripts){_SOME}",
    rf"(?:cette|ce|l) ?(?:page|application|site|tableau|vue|document){_FEW} (?:nécessite|requiert|a besoin de?|ne fonctionne pas sans){_FEW} (?:javascript|scripts?)(?: [^ ]+){{0,8}}",
    rf"(?:javascript|les scripts?) (?:est|sont|doit|doivent|semble|semblent){_FEW} (?:désactivée?s?|activée?s?|bloquée?s?|requis|nécessaires?){_FEW}",
    rf"votre navigateur (?:ne prend|n exécute|bloque|ne gère|n accepte){_FEW} (?:javascript|scripts?){_FEW}",
    # es
    rf"(?:por favor )?(?:active|activa|habilite|permita) (?:javascript|los scripts|scripts|la ejecución de scripts){_SOME}",
    rf"(?:esta|este|la) (?:aplicación|página|sitio|panel|vista)(?: solo| sólo)? (?:necesita|requiere|precisa|funciona con) (?:javascript|scripts?){_SOME}",
    rf"(?:javascript|los scripts) (?:está|están|debe|deben|parece|parecen){_FEW} (?:desactivad[ao]s?|activad[ao]s?|bloquead[ao]s?|habilitad[ao]s?|deshabilitad[ao]s?){_FEW}",
    rf"su navegador (?:los tiene desactivados|no admite|no ejecuta|bloquea|no permite){_FEW}",
    # pt
    rf"(?:por favor )?(?:ative|habilite|permita|ligue) (?:o )?(?:javascript|os scripts|scripts|a execução de scripts){_SOME}",
    rf"(?:esta|este|o|a) (?:página|aplicativo|aplicação|site|painel|visão) (?:precisa de|requer|necessita de|exige) (?:javascript|scripts?){_SOME}",
    rf"(?:o javascript|javascript|os scripts) (?:está|estão|deve|devem|parece){_FEW} (?:desativad[ao]s?|ativad[ao]s?|bloquead[ao]s?|habilitad[ao]s?|desabilitad[ao]s?|desligad[ao]s?){_FEW}",
    # ru
    rf"(?:пожалуйста )?(?:включите|разрешите|активируйте) (?:javascript|выполнение скриптов|скрипты|сценарии|поддержку javascript){_SOME}",
    rf"(?:для|этой|этому) [^ ]+{_FEW} (?:нужны?|нужен|требу[^ ]+|необходим[^ ]*) (?:javascript|скрипты|сценарии){_FEW}",
    rf"(?:javascript|скрипты|сценарии|в вашем браузере|ваш браузер){_FEW} (?:отключ[^ ]+|выключ[^ ]+|не поддерживает[^ ]*|заблокир[^ ]+)(?: [^ ]+){{0,3}}",
    # zh ja
    r"请.{0,12}(?:启用|开启|允许|打开|激活).{0,6}(?:javascript|脚本|js).{0,16}",
    r"您的浏览器.{0,12}(?:javascript|脚本).{0,16}",
    r"(?:本|此|该)(?:页面|应用|网站|站点|控制台).{0,8}(?:需要|必须|依赖).{0,12}(?:javascript|脚本).{0,8}",
    r".{0,24}(?:javascript|スクリプト).{0,2}(?:を有効にして|を許可して|が必要です|が無効|がオフ|を有効化|がブロック|をオンに|の実行を許可).{0,12}",
    r"(?:ブラウザーの)?設定を変更して再読み込み.{0,8}",
]

#: An error message to the reader.
ERROR = [
    # codes and titles
    rf"(?:http |error |code |status )*0(?: {_CODE})?",
    rf"{_CODE}(?: 0)?",
    r"(?:error|erreur|fehler|erro|ошибка) 0(?: [^ ]+){0,3}",
    r"0 ?(?:错误|エラー|ошибка|erreur|fehler|erro|error)",
    r"(?:错误|エラー) ?0",
    rf"(?:oops|whoops|uh oh|sorry)(?: something went wrong| {_CODE})?",
    r"(?:something|oops something) went wrong",
    rf"{_PAGE} (?:unavailable|missing|gone|not found|does not exist)",
    r"(?:access|permission) (?:denied|forbidden)",
    r"(?:internal server|application|server|unexpected|gateway|proxy|network|fatal) error",
    r"(?:sign in|login|0) required|session expired|(?:under )?maintenance",
    r"(?:interner serverfehler|erreur interne(?: du serveur)?|error interno(?: del servidor)?|erro interno(?: do servidor)?|внутренняя ошибка(?: сервера)?)",
    r"this page (?:is not|isn t) working(?: right now)?",
    # sentences, en
    rf"(?:sorry )?(?:the|this|that) {_PAGE} (?:you (?:asked|were looking|are looking|requested)(?: for)?|requested|you requested)? ?(?:could not|couldn t|cannot|can t|was not|has not) be(?:en)? (?:found|loaded|opened|displayed){_FEW}",
    rf"(?:sorry )?(?:the|this|that) {_PAGE} (?:was|has been|had been|may have been|might have been) (?:moved|removed|deleted)(?: or{_FEW})?",
    rf"(?:sorry )?(?:the|this|that) {_PAGE}(?: you [^ ]+(?: [^ ]+)?)? (?:is no longer available|no longer exists|does not exist|doesn t exist|never existed|has expired|is not available)",
    rf"the link may be (?:old|broken|expired|outdated)(?: or{_SOME})?(?: [^ ]+)?",
    rf"your (?:session|login|sign in|0|token) (?:has )?(?:expired|ended|timed out){_SOME}",
    r"(?:please )?(?:sign|log) in (?:again )?to (?:continue|read|view|see|proceed)(?: [^ ]+){0,2}",
    rf"you (?:do not|don t|no longer) have (?:the )?(?:permission|access|rights?|authori[sz]ation) (?:to|for){_FEW}",
    rf"you are not (?:allowed|authori[sz]ed|permitted) to (?:view|read|see|open|access){_FEW}",
    rf"your account (?:is not on|is not allowed|is suspended|is locked|is disabled|is missing){_SOME}",
    r"too many requests from your (?:address|network|account)(?: [^ ]+){0,6}",
    rf"(?:quota|limit|allowance) (?:for|of) [^ ]+ (?:is|has been) (?:used up|exhausted|reached|exceeded)(?: come back{_FEW})?",
    r"none of (?:our|the) servers (?:could|can|was able to) (?:take|answer|serve|handle) (?:the|your|this) request",
    r"the (?:request|connection|server|upstream|gateway|origin|viewer|renderer|document service|service|site)(?: [^ ]+){0,3} (?:took longer than 0 and was cancelled(?: by [^ ]+ [^ ]+)?|timed out|closed the connection before answering|is down for maintenance(?: until 0)?|is (?:temporarily |currently )?(?:down|unavailable|overloaded)|did not respond)",
    r"the viewer crashed while opening the document(?: our team has been (?:told|notified|informed))?",
    r"an? (?:unexpected|unknown|internal) (?:condition|error|problem|failure) (?:occurred|has occurred|prevented us from completing your request)",
    rf"(?:could not|couldn t|unable to|failed to|cannot|can t) (?:connect to the (?:database|server|service|backend)|fetch content|fetch the {_PAGE}|load (?:the|this) {_PAGE}|open (?:the|this) {_PAGE}|reach the server|process your request|complete your request){_SOME}",
    rf"(?:sorry )?we (?:could not|couldn t|cannot|can t|were unable to|are unable to) (?:load|open|find|show|display|fetch|render|process|complete|retrieve) (?:the|this|that|your)(?: [^ ]+)? (?:{_PAGE}|request)",
    rf"(?:sorry )?we (?:hit a snag|ran into a problem|encountered an error)(?: while (?:rendering|loading|opening) (?:the|this) {_PAGE})?",
    rf"if you keep seeing this(?: (?:tell|contact|ask){_SOME}(?: [^ ]+){{0,3}})?",
    r"if (?:the|this) (?:problem|error|issue) (?:persists|continues)(?: please)? (?:contact|tell|call|ask)(?: [^ ]+){1,4}",
    r"(?:please )?(?:try|reload|refresh|retry|come back)(?: the page| this page)?(?: again)? (?:later|in 0|in a (?:minute|moment|while|few [^ ]+)|in some [^ ]+|after 0)",
    r"(?:the|our) team has been (?:told|notified|informed)",
    r"down for maintenance(?: until 0)?|(?:we ll|we will) be back (?:soon|shortly|at 0)",
    r"request (?:id|reference) 0(?: node 0)?",
    # de
    r"(?:die|der|das) (?:angeforderte|gesuchte|gewünschte|aufgerufene)[^ ]* (?:seite|dokument|adresse)(?: [^ ]+){1,5}",
    r"(?:seite|dokument) (?:nicht gefunden|nicht verfügbar|existiert nicht)|zugriff (?:verweigert|verboten)",
    r"(?:der|unser) (?:server|dienst) (?:kann die anfrage|ist|antwortet)(?: [^ ]+){0,3} (?:nicht bearbeiten|nicht|ausgefallen|überlastet|verfügbar|erreichbar)",
    r"(?:ihre )?sitzung ist abgelaufen(?: bitte melden sie sich(?: [^ ]+)? an)?",
    r"sie haben keine (?:berechtigung|rechte|zugriffsrechte)(?: [^ ]+){0,5}",
    r"(?:es ist )?ein (?:unerwarteter|interner|unbekannter) fehler (?:aufgetreten|ist aufgetreten)(?: [^ ]+){0,5}",
    r"(?:bitte )?(?:versuchen sie es|probieren sie es|melden sie sich)(?: [^ ]+){0,3} (?:später|erneut|noch einmal|wieder)(?: [^ ]+)?",
    r"zu viele anfragen|anmeldung erforderlich|dienst nicht verfügbar(?: 0)?|fehler aufgetreten",
    # fr
    r"(?:la|cette) page (?:demandée|recherchée)(?: [^ ]+){0,2} (?:n existe|est introuvable|introuvable)(?: [^ ]+){0,6}",
    r"(?:page|document) (?:non trouvée?|introuvable|indisponible)|accès (?:refusé|interdit)|service (?:temporairement )?indisponible(?: 0)?",
    r"une erreur (?:inattendue|interne)? ?(?:est survenue|s est produite)(?: réessayez(?: [^ ]+){0,3})?",
    r"votre session (?:a expiré|est expirée|est terminée)(?: veuillez vous reconnecter)?",
    r"vous n avez pas (?:le droit|accès|l autorisation|les droits|la permission)(?: [^ ]+){0,5}",
    # es
    r"(?:la|esta) página (?:solicitada|que busca) (?:no existe|no se encuentra|no está disponible|ha sido (?:movida|eliminada))",
    r"(?:página|documento) (?:no encontrad[ao]|no disponible|inexistente)|acceso (?:denegado|prohibido)|servicio no disponible(?: 0)?",
    r"(?:ha ocurrido|se produjo|se ha producido|hubo) un error(?: [^ ]+)?(?: inténtelo(?: [^ ]+){0,3})?",
    r"su sesión (?:ha caducado|ha expirado|caducó|expiró|ha terminado)(?: inicie sesión(?: [^ ]+){0,3})?",
    r"(?:usted )?no tiene (?:permiso|permisos|acceso|autorización) (?:para|a)(?: [^ ]+){1,4}",
    # pt
    r"(?:a|esta) página (?:solicitada|procurada|pedida) (?:não existe|não foi encontrada|foi (?:movida|removida))(?: [^ ]+){0,3}",
    r"(?:página|documento) (?:não encontrad[ao]|indisponível|inexistente)|acesso (?:negado|proibido|recusado)|serviço indisponível(?: 0)?",
    r"(?:ocorreu|houve|aconteceu) um erro(?: [^ ]+)?(?: tente(?: [^ ]+){0,3})?",
    r"(?:a )?sua sessão (?:expirou|terminou|caducou|foi encerrada)(?: (?:entre|inicie)(?: [^ ]+){0,3})?",
    r"(?:você )?não tem (?:permissão|acesso|autorização) (?:para|a)(?: [^ ]+){1,4}",
    # ru
    r"(?:запрошенная|запрашиваемая)(?: вами)? страница (?:не найдена|не существует|удалена|перемещена|недоступна)(?: [^ ]+){0,3}",
    r"страница (?:не найдена|недоступна|не существует|удалена)|доступ (?:запрещ[её]н|закрыт)|в доступе отказано",
    r"(?:произошла|возникла|случилась)(?: [^ ]+)? ошибка(?: [^ ]+){0,3}",
    r"(?:ваш )?(?:сеанс|сессия) (?:ист[её]к|истекла|заверш[её]н|завершена|окончен)(?: войдите(?: [^ ]+)?)?",
    r"у вас нет (?:прав|доступа|разрешения)(?: [^ ]+){0,4}",
    r"(?:сервис|сервер|служба) (?:временно |сейчас )?(?:недоступ[^ ]+|не отвечает|перегруж[^ ]+)(?: (?:попробуйте|повторите)(?: [^ ]+){0,3})?",
    # zh ja
    r"(?:您|你)(?:访问|请求|查找|要找|所访问|所请求)的?(?:页面|网页|文档).{0,10}(?:不存在|未找到|找不到|移除|删除).{0,6}",
    r"(?:页面|网页|文档)(?:不存在|未找到|已被?删除|已移除|无法(?:显示|打开|访问))",
    r"(?:服务|服务器|系统)(?:暂时|当前|目前)?(?:不可用|出错|繁忙|错误|维护中|未响应)(?: ?请.{2,8})?",
    r"(?:发生|出现)了?(?:意外|未知|内部)?(?:错误|异常).{0,10}|(?:服务器|系统|应用)?(?:内部|未知|意外)(?:错误|异常)",
    r"(?:会话|登录)(?:已|状态已)?(?:过期|失效|超时)(?: ?请.{2,8})?",
    r"(?:您|你)(?:没有|无)(?:权限|权).{0,12}|(?:访问|权限)(?:被拒绝|受限|被禁止|不足)|拒绝访问|禁止访问",
    r"(?:请)(?:稍后|重新登录|再试|重试).{0,6}",
    r"(?:お探し|ご指定|要求された)の?(?:ページ|文書).{0,16}(?:見つかりません|削除されました|ありません).{0,4}",
    r"(?:ページ|文書)が(?:見つかりません|存在しません|表示できません)",
    r"アクセス(?:が拒否|拒否|が禁止).{0,8}|(?:サーバー)?エラー",
    r"(?:予期しない|予期せぬ|内部|不明な)?エラーが発生.{0,8}",
    r"(?:セッション|ログイン)の?(?:有効期限|期限)が(?:切れ|過ぎ).{0,6}",
    r"(?:しばらくして|時間をおいて|後ほど).{0,4}(?:もう一度|再度).{0,12}|再度?ログイン.{0,8}",
    r"(?:サービス|サーバー)は?が?(?:現在|一時的に)?.{0,6}(?:利用できません|停止中|応答しません|混み合っています|メンテナンス中).{0,4}",
    r"(?:この)(?:文書|ページ)を(?:閲覧|表示|読む).{0,4}(?:権限|許可).{0,10}",
]

#: Filler where content should be.
FILLER = [
    r"(?:asdf|qwer|qwerty|foo|bar|foobar|blah|bla|test|xxx|yyy|zzz|aaa)(?: (?:asdf|qwer|qwerty|foo|bar|foobar|blah|bla|test|xxx|yyy|zzz|aaa))*",
    r"tbd|tba|todo|tbc|n a|fixme",
    r"(?:body text|insert text|your text|text here|content here|headline|placeholder|sample text|dummy text|image)(?: here)?",
    r"(?:text|content|description|copy|body|summary|details) (?:goes here|to go here|comes here|to come|will appear here|will follow|follows|coming soon|to follow|to be added|to be supplied)",
    r"(?:more|content|text|details|description|information|article|page) (?:is )?(?:coming soon|to follow|will follow|follows|to come|to be (?:added|written|provided|supplied|announced))",
    r"(?:this )?(?:section|page|site|article|chapter) (?:is )?(?:under construction|coming soon|in preparation|being written)",
    r"this (?:space|paragraph|block|section|area|text|page|column) (?:is|was|will be) (?:left|reserved|intended) (?:for|blank)(?: [^ ]+){0,4}",
    r"this is (?:sample|dummy|placeholder|filler|example|test) (?:text|copy|content|paragraph)(?: [^ ]+){0,8}",
    r"(?:replace|overwrite|delete|remove|fill in|edit) (?:this|the) (?:block|text|paragraph|section|copy|placeholder|line|sentence)(?: (?:before|with|when|once|later)(?: [^ ]+){0,4})?",
    r"your [^ ]+ (?:goes|go|comes|belongs) (?:in|here|on)(?: [^ ]+){0,2}",
    r"(?:write|add|insert|put|enter|type|describe) (?:something|a (?:short|brief)(?: [^ ]+)?|your|some)(?: [^ ]+){0,4} (?:here|about|below)(?: [^ ]+){0,2}",
    r"(?:dummy|sample|placeholder|filler|example) (?:paragraph|text|copy|content|sentence|headline|words)(?: (?:for|used|only|to)(?: [^ ]+){0,8})?",
    r"(?:lead|intro|introductory|first|opening|closing) (?:paragraph|sentence|text) (?:to be|will be|goes|comes)(?: [^ ]+){0,6}",
    r"(?:(?:first|second|third) item ?)+|item one item two item three",
    r"heading (?:one|two|three|four|0)",
    r"nothing to see here yet|click to edit|(?:double click|0) to edit|start typing|untitled document",
    # de
    r"(?:blindtext|platzhalter|beispieltext|mustertext|fülltext|dummytext)(?: [^ ]+){0,5}",
    r"(?:inhalt|text|beschreibung|weiteres|mehr) (?:folgt|kommt)(?: [^ ]+){0,3}",
    r"hier (?:steht|kommt|folgt|entsteht|erscheint)(?: [^ ]+){0,3} (?:text|inhalt|beschreibung|seite)",
    # fr
    r"(?:texte|contenu|paragraphe) (?:à venir|de remplissage|d exemple|factice|fictif|provisoire|bientôt|à remplacer|à compléter|ici)(?: [^ ]+){0,4}",
    r"(?:insérez|ajoutez|écrivez|saisissez|mettez|placez) (?:ici|votre|une|un)(?: [^ ]+){0,4}",
    r"(?:cette )?(?:section|page|rubrique) (?:est )?en (?:construction|cours(?: [^ ]+){0,3})",
    r"ceci est (?:un |du )?(?:faux )?(?:texte|paragraphe)",
    # es
    r"(?:texto|contenido|párrafo) (?:de relleno|de ejemplo|de muestra|de prueba|próximamente|provisional|pendiente|por definir|aquí|simulado)(?: [^ ]+){0,4}",
    r"(?:escriba|inserte|añada|agregue|introduzca|coloque) (?:aquí|su|una|un)(?: [^ ]+){0,4}",
    r"(?:esta )?(?:sección|página) (?:está )?en (?:construcción|obras|preparación)",
    # pt
    r"(?:texto|conteúdo|parágrafo) (?:de preenchimento|de exemplo|de teste|provisório|em breve|fictício|a definir|aqui|simulado|de amostra)(?: [^ ]+){0,4}",
    r"(?:escreva|insira|adicione|coloque|digite) (?:aqui|seu|sua|uma|um)(?: [^ ]+){0,4}",
    r"(?:esta )?(?:seção|secção|página) (?:está )?em (?:construção|obras|preparação)",
    # ru
    r"(?:здесь|тут) (?:будет|появится|должен быть)(?: [^ ]+){0,4}",
    r"(?:раздел|страница) (?:в разработке|находится в разработке)",
    r"(?:текст|пример)(?: [^ ]+)? (?:заполнитель|рыба|замены|примера|для макета|текста)(?: [^ ]+){0,4}",
    r"(?:вставьте|введите|добавьте|напишите) (?:сюда|здесь|свой|ваш|описание|текст)(?: [^ ]+){0,4}",
    r"(?:содержимое|содержание|описание|текст) (?:скоро|появится|будет)(?: [^ ]+){0,4}",
    # zh ja
    r"(?:此处|这里|在此|在这里)(?:填写|输入|插入|添加|放置|写|为|是|将).{0,12}",
    r"(?:内容|正文|页面|本节|说明)(?:即将|稍后|正在|待|建设).{0,10}",
    r"(?:示例|占位|样例|测试|填充|范例)(?:文字|文本|内容|段落|符).{0,12}",
    r"(?:ここ|こちら)に.{0,10}(?:入り|入れ|記入|記載|入力|挿入).{0,8}",
    r"(?:ダミー|サンプル|仮の?)(?:テキスト|文|文章|文書).{0,8}",
    r"(?:内容|本文|詳細|このページ)は.{0,6}(?:準備中|作成中|工事中|未定).{0,6}|(?:準備中|工事中|近日公開)",
]

#: Navigation and other page frame: neither residue nor content.
FRAME = [
    r"(?:home|search|runbooks?|docs?|documentation|incidents?|dashboards?|alerts?|logs?|status|help|login|log in|sign in|menu|about|contact|contact support|support|settings|workspace|overview|reload|refresh|retry|go back|back|next|previous|close|cancel|ok|yes|no|skip to content|skip to main content|return to the start page|return to start|back to start|back to home|privacy|imprint|terms|cookies?|feedback|print|share|index)",
    r"(?:error|message|title|detail|code|reason)",
    r"(?:volver al inicio|inicio|startseite|zur startseite|zurück|zurück zur startseite|accueil|retour à l accueil|retour|voltar ao início|voltar|página inicial|на главную|главная|назад|вернуться на главную|首页|返回首页|返回|ホーム|トップへ戻る|ホームに戻る|戻る|hilfe|suche|menü|buscar|ayuda|aide|rechercher|ajuda|поиск|помощь|搜索|帮助|検索|ヘルプ)",
    r"(?:reference|request id|incident code|vorgang|référence|referencia|referência|código|codigo|номер|код|идентификатор|错误编号|参考编号|编号|请求编号|参照番号|受付番号|error code|code|ref|trace|support code|ticket|case)(?: no| nr| id| number| code)? ?0(?: (?:node|knoten|nœud|nodo|nó|узел|节点|ノード) ?0)?",
    r"(?:c|copyright) 0(?: [^ ]+){0,5}",
]

#: Words of the usual Latin filler; a segment made mostly of them is filler.
LATIN = """
lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua
enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in
reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa
qui officia deserunt mollit anim id est laborum viverra pulvinar mattis ornare semper justo turpis urna massa eget risus
porta vitae fusce donec nunc vestibulum pellentesque habitant morbi tristique senectus netus malesuada fames ac egestas
""".split()
