"""Wordings for problem 1 that stand in none of the tables: messages and filler, and sentences that only speak of such things."""

MESSAGES = """
Sorry, this page doesn't exist.|HTTP ERROR 500|Error 503: backend fetch failed.|We can't seem to find what you're looking for.|This site can't be reached.|The resource has been permanently deleted.|You are not authorized to see this content.|Our servers are overloaded right now.|Please reload the page or come back later.|JavaScript must be switched on to use this application.|Your browser has scripts turned off.|Insert your headline here.|This text is only a placeholder.|Replace this paragraph with your own copy.|410 Gone|Request timed out.|We're having technical difficulties.|Website under maintenance, check back soon.
Diese Seite gibt es nicht mehr.|Leider konnten wir die Seite nicht finden.|Der Server antwortet nicht.|Sie haben keinen Zugang zu diesem Bereich.|Es ist ein unerwartetes Problem aufgetreten.|Für diese Website muss JavaScript eingeschaltet sein.|Ihr Browser unterstützt kein JavaScript.|Bitte laden Sie die Seite neu.|Dies ist nur ein Platzhalter.|Geben Sie hier Ihre Überschrift ein.
Oups, cette page a disparu.|Nous n'avons pas trouvé la page recherchée.|Le serveur ne répond pas.|Vous n'avez pas accès à ce contenu.|Un problème technique est survenu.|JavaScript doit être activé dans votre navigateur.|Merci de recharger la page.|Remplacez ce texte par le vôtre.|Titre à saisir ici.|Le site est momentanément fermé pour entretien.
Lo sentimos, esta página ya no está disponible.|No encontramos lo que busca.|El servidor no responde.|No tiene autorización para ver este contenido.|Ha ocurrido un problema inesperado.|Debe activar JavaScript en su navegador.|Vuelva a cargar la página.|Este es un texto provisional.|Introduzca aquí el título.|Sitio en obras.
Desculpe, esta página já não está disponível.|Não encontrámos o que procura.|O servidor não responde.|Não está autorizado a ver este conteúdo.|Algo correu mal.|É preciso ligar o JavaScript no navegador.|Atualize a página e tente outra vez.|Isto é apenas um texto provisório.|Escreva aqui o título.|Site em construção.
Deze pagina is niet meer beschikbaar.|We konden de pagina niet vinden.|De server reageert niet.|U bent niet bevoegd om deze inhoud te bekijken.|Er is een onverwacht probleem opgetreden.|JavaScript moet zijn ingeschakeld.|Vernieuw de pagina en probeer opnieuw.|Dit is slechts een tijdelijke tekst.|Vul hier uw titel in.|Website in aanbouw.
Przepraszamy, tej strony już nie ma.|Nie udało się znaleźć strony.|Serwer nie odpowiada.|Nie masz dostępu do tej treści.|Wystąpił nieoczekiwany problem.|JavaScript musi być włączony w przeglądarce.|Odśwież stronę i spróbuj jeszcze raz.|To jest tylko tekst tymczasowy.|Wpisz tu swój nagłówek.|Strona w budowie.
Извините, такой страницы нет.|Мы не смогли найти эту страницу.|Сервер не отвечает.|У вас нет доступа к этому разделу.|Что-то пошло не так.|В браузере отключён JavaScript.|Обновите страницу и повторите попытку.|Здесь будет ваш заголовок.|Это временный текст.|Сайт находится в разработке.
申し訳ございませんが、このページは削除されました。|ご指定のページは見つかりませんでした。|サーバーが応答していません。|このコンテンツを閲覧する権限がありません。|予期しない問題が発生しました。|ブラウザのJavaScriptをオンにしてください。|ページを再読み込みしてください。|ここに見出しを入力してください。|これは仮のテキストです。|現在工事中です。
"""
PROSE = """
Our guide explains how shops can reduce page not found errors after a redesign.|The team fixed an error in the billing report within two days.|Server maintenance contracts are available for all sites.|JavaScript developers join our platform group every spring.|We replace worn parts and send you a written report.|Our editors write two or three lines about every product.|Access to the building is denied after nine in the evening to protect guests.|The new portal requires a browser and a company account.|Please try our new blend in the shop.|Your text messages are delivered within seconds.|Click the map to find the nearest branch.|The archive holds sample pages from early printed books.|Visitors may not find parking near the harbour.|The road to the yard is under construction until June.|An internal review found no problems.|Our hotline answers within five minutes.|Requests are handled on working days.|The permission form must be signed by both parties.
Unser Leitfaden erklärt, wie Händler Fehlerseiten vermeiden.|Wir ersetzen verschlissene Teile innerhalb von zwei Tagen.|Die Wartung der Anlage erfolgt jedes Jahr im Mai.|Zugang zum Lager haben nur geschulte Personen.|Schreiben Sie uns, wenn Sie Fragen haben.
Notre équipe corrige les erreurs de facturation en deux jours.|L'entretien des machines est compris dans le contrat.|L'accès au dépôt est réservé aux visiteurs inscrits.|Nous cherchons des développeurs JavaScript à Lyon.
El servidor de la biblioteca se revisa cada lunes.|No tiene que pagar el envío.|Nuestra guía explica cómo evitar errores comunes.|La obra está en construcción hasta mayo.
O nosso guia ajuda a evitar erros comuns.|A manutenção anual está incluída no preço.|Não precisa de marcar a visita.
Onze gids helpt fouten in facturen te vermijden.|Het onderhoud van de pomp is inbegrepen.|U hoeft niet te wachten op antwoord.
Nasz poradnik pomaga unikać błędów na fakturach.|Przegląd techniczny serwera odbywa się co roku.|Nie trzeba czekać na odpowiedź.
Наш справочник помогает избежать ошибок в счетах.|Доступ на склад открыт по будням.|Мы обновляем страницу новостей каждую неделю.
請求書の誤りを減らす方法を紹介します。|倉庫への出入りは平日に限ります。|新しいページを毎週公開しています。
"""
#: Written after the words of the operator were settled, and read once.
LATER = """
The document you tried to open has been removed.|Nothing was found at this address.|500 - Server Error|You don't have the rights to open this section.|Connection refused by host.|Scripts must be enabled to run this page.|Type your paragraph here.|Sample heading
Die Datei wurde gelöscht oder verschoben.|Zugriff gesperrt.|Der Dienst ist derzeit nicht erreichbar.|Ohne JavaScript kann diese Anwendung nicht laufen.|Hier Text eingeben.
Ce fichier a été supprimé.|Accès interdit.|Le service est temporairement interrompu.|Activez les scripts pour continuer.|Insérez votre texte ici.
El archivo fue eliminado.|Acceso prohibido.|La conexión con el servidor falló.|Se requiere JavaScript.|Añada aquí su texto.
O ficheiro foi removido.|Acesso proibido.|A ligação ao servidor falhou.|Ative os scripts no navegador.|Adicione aqui o seu texto.
Het bestand is verwijderd.|Toegang verboden.|De verbinding is mislukt.|Schakel scripts in.|Voeg hier uw tekst in.
Plik został usunięty.|Dostęp zabroniony.|Połączenie z serwerem nieudane.|Włącz skrypty w przeglądarce.|Dodaj tutaj tekst.
Файл был удалён.|Доступ закрыт.|Соединение с сервером прервано.|Для работы сайта нужны скрипты.|Введите текст здесь.
ファイルは削除されました。|アクセスは禁止されています。|サーバーに接続できません。|スクリプトを有効にしてください。|ここに本文を入力。
"""


def listed(block: str) -> list[str]:
    return [x for line in block.strip().split("\n") for x in line.split("|")]
