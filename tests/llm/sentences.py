"""Clean sentences in many languages; none may be changed."""

SENTENCES = {
"fr": ["Le président a été réélu à l'unanimité", "L’élève naïf mangeait des crêpes près du château où l’été s’achève", "Où est passé le garçon français ? Çà et là, déjà."],
"es": ["El señor Muñoz viajó a España con su niña pequeña", "¿Dónde está la estación más próxima? ¡Qué sorpresa!", "La organización aprobó la resolución en Córdoba"],
"pt": ["A situação não é fácil, mas as ações são necessárias", "O cônjuge também ficará à disposição da comissão", "São João, três irmãos, avô e avó"],
"de": ["Die Prüfung der Größe erfolgt gemäß § 5 über die Behörde", "Schöne Grüße aus München, äußerst höflich", "ÜBERPRÜFUNG DER MASSNAHMEN FÜR FLÜSSE"],
"it": ["La città è più bella perché c'è il caffè", "Perciò l'università sarà così", "Può darsi che sia già lì"],
"sv": ["Är det möjligt att åka båt på sjön i år?", "Östersjön och Ångström på svenska"],
"da": ["Rødgrød med fløde på en ø i åen", "Æbler og pærer, både små og store"],
"fi": ["Hyvää päivää, yötä myöten sähköä", "Äiti pyysi lisää leipää"],
"pl": ["Zażółć gęślą jaźń, proszę państwa", "Ustawa o służbie cywilnej wchodzi w życie", "Łódź, Kraków i Gdańsk są piękne"],
"cs": ["Příliš žluťoučký kůň úpěl ďábelské ódy", "Česká republika přijala nový zákon"],
"hu": ["Árvíztűrő tükörfúrógép", "Az őszi időben gyönyörű erdők"],
"ro": ["Ședința comisiei și hotărârea în țară", "Înțelegerea părților și apărarea drepturilor"],
"uk": ["Її їжак їв кашу, а її сестра ґречно чекала", "Україна та її громадяни мають право", "Верховна Рада України прийняла закон про їхні права"],
"bg": ["Българският език е част от културата", "Съветът прие решението във връзка с бюджета"],
"el": ["Η ελληνική γλώσσα είναι όμορφη", "Το Συμβούλιο αποφάσισε χθες"],
"ar": ["اللغة العربية جميلة جدا", "قرر المجلس أمس"],
"he": ["השפה העברית יפה מאוד"],
"zh": ["中华人民共和国宪法规定公民的权利", "委员会决定明天开会"],
"ja": ["日本国憲法は国民の権利を定める", "カタカナとひらがな"],
"ko": ["대한민국 헌법은 국민의 권리를 정한다"],
"vi": ["Cộng hòa xã hội chủ nghĩa Việt Nam độc lập tự do", "Ủy ban nhân dân đã quyết định"],
"ka": ["საქართველოს კონსტიტუცია იცავს უფლებებს"],
"kk": ["Қазақстан Республикасының Конституциясы әрбір азаматтың құқығын қорғайды", "Ұлттық кеңес шешім қабылдады"],
"sr": ["Ђорђе и Љубица су дошли у Њушу са ћерком"],
"tr": ["Açık kurulu kira sözleşmesinin kullanımını belirler", "İSTANBUL BÜYÜKŞEHİR BELEDİYESİ"],
"az": ["Şəhər Soveti qərarını dərc etdi", "AZƏRBAYCAN RESPUBLİKASI"],
"ru": ["Совет объявляет решение об охране участка", "УКАЗ ПРЕЗИДЕНТА РОССИЙСКОЙ ФЕДЕРАЦИИ О НАЗНАЧЕНИИ МИНИСТРА", "ГОСТ Р и СССР, а также МВД", "Съезд ещё не объявлен"],
"emoji": ["Great 👍🏽 job 🎉 — see you ❤️", "Ok 😀"],
"is": ["Þetta er íslenska, já og nei, ðað"],
"lv": ["Šķīstā ūdens žņaugs ķēdē"],
"et": ["Õhtul sõidame järve äärde"],
}
